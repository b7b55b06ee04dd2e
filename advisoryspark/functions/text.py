"""Text cleaning, tokens and first-match rule labels as Column expressions."""

import re
from functools import reduce

from pyspark.sql import Column, functions as F

from advisoryspark import fixed_values as fx
from advisoryspark.functions import pieces

RULESETS = {
    "current": (fx.EXPLOIT_RULES, fx.COMPONENT_RULES, fx.IMPACT_RULES),
    "research": (fx.RESEARCH_EXPLOIT_RULES, fx.RESEARCH_COMPONENT_RULES, fx.RESEARCH_IMPACT_RULES),
}


def clean_text(text: Column) -> Column:
    """Lower case, every run of characters outside a-z and 0-9 becomes one space."""
    return F.coalesce(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), F.lit(""))


def tokens(cleaned: Column) -> Column:
    """Whitespace tokens of a cleaned text; no tokens for an empty text."""
    return F.filter(F.split(cleaned, " "), lambda t: t != "")


def excerpt(text: Column, length: int = 120) -> Column:
    """Opening characters of a text followed by an ellipsis, for report headers."""
    return F.concat(F.substring(text, 1, length), F.lit("..."))


def _java_regex(pattern: str) -> str:
    # (?d): only \n ends a line for '.'; (?U): \b follows Unicode letters.
    return ("(?dU)" if "\\b" in pattern else "(?d)") + pattern


def _pieces(alternative: str) -> list[str]:
    """Literal pieces of an alternative, in order; the whole of it where it has no wildcards."""
    escaped = alternative.replace("\\.", "\0")
    return [p.replace("\0", ".") for p in re.split(r"\\b|\.\*|\.", escaped) if p]


def _is_regex(pattern: str) -> bool:
    """Whether a pattern has more than alternatives of literals, '.', '.*' and word ends."""
    return re.search(r"[\[\](){}+?^$]|\\[^b.]|(?<!\.)\*", pattern) is not None


def rule_pieces(*rules: list[tuple[str, str]]) -> tuple[str, ...]:
    """The literal pieces of rules that `pieces.look` can look for."""
    patterns = [pattern for listed in rules for _, pattern in listed if not _is_regex(pattern)]
    found = {p for pattern in patterns for alternative in pattern.split("|") for p in _pieces(alternative)}
    return tuple(sorted(p for p in found if len(p.encode()) >= pieces.WIDTH))


class Lowered:
    """A lower-cased text, with what `pieces.look` saw in it if it was looked through for `known` pieces."""

    def __init__(self, text: Column, looked: Column | None = None, known: tuple[str, ...] = ()) -> None:
        self.text, self.looked, self.number = text, looked, {p: i for i, p in enumerate(known)}

    def contains(self, any_of: list[str]) -> Column:
        """Whether the text holds one of the pieces."""
        seen = [self.number[p] for p in any_of if p in self.number]
        tests = [pieces.bits(self.looked, seen)] if seen else []
        return reduce(Column.__or__, tests + [self.text.contains(p) for p in any_of if p not in self.number])

    def rlike(self, regex: str) -> Column:
        return self.text.rlike(regex)


def _guarded(lowered: Lowered, alternative: str) -> Column:
    """An alternative with wildcards runs its regex only on texts that hold all its
    literal pieces, so nearly every text is settled by substring tests instead of a
    backtracking regex."""
    test = lowered.rlike(_java_regex(alternative))
    for piece in sorted(set(_pieces(alternative)), key=lambda p: (len(p), p)):
        test = lowered.contains([piece]) & test
    return test


def matches_rule(lowered: Column | Lowered, pattern: str) -> Column:
    """True where the lower-cased text matches the rule's regular expression."""
    lowered = Lowered(lowered) if isinstance(lowered, Column) else lowered
    if _is_regex(pattern):
        return lowered.rlike(_java_regex(pattern))
    plain, wild = [], []
    for alternative in pattern.split("|"):
        found = _pieces(alternative)
        whole = found == [alternative.replace("\\.", ".")]
        (plain if whole else wild).append(found[0] if whole else alternative)
    tests = [lowered.contains(plain)] if plain else []
    return reduce(Column.__or__, tests + [_guarded(lowered, alternative) for alternative in wild])


def first_match(lowered: Column | Lowered, rules: list[tuple[str, str]], default: str) -> Column:
    """Label of the first rule in order that matches, else `default`."""
    label = None
    for name, pattern in rules:
        test = matches_rule(lowered, pattern)
        label = F.when(test, name) if label is None else label.when(test, name)
    return label.otherwise(default)


def all_matches(lowered: Column | Lowered, rules: list[tuple[str, str]], default: str) -> Column:
    """Labels of all rules that match, joined in rule order, else `default`."""
    flags = [F.when(matches_rule(lowered, pattern), name) for name, pattern in rules]
    return F.coalesce(F.nullif(F.concat_ws(", ", *flags), F.lit("")), F.lit(default))


def exploit_type(text: Column, ruleset: str = "current") -> Column:
    return first_match(F.lower(text), RULESETS[ruleset][0], fx.DEFAULT_EXPLOIT)


def component(text: Column, ruleset: str = "current") -> Column:
    return first_match(F.lower(text), RULESETS[ruleset][1], fx.DEFAULT_COMPONENT)


def impact(text: Column, ruleset: str = "current") -> Column:
    return all_matches(F.lower(text), RULESETS[ruleset][2], fx.DEFAULT_IMPACT)
