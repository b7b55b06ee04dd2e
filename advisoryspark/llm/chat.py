"""Chat formatting with typed content parts (native: DataFrame functions only).

A turn holds an array of parts (type, text, ref, width, height, seconds, pages).
The visitor goes through them in order: text is escaped and kept, an image, audio
or document part becomes a placeholder, and its attachment is recorded with its
place and the tokens it will take.  Control strings are written only by the
template: in texts, roles and references they are escaped by one more backslash
behind their first character, which `unescape` takes away again.  Neighbouring
texts are joined before that, as a control string may begin in one and end in the next.

Defined cases: null text and null roles are empty; null or empty parts add
nothing; a part of unknown or null type is treated as text; rows with equal turns
are ordered by role and content; repeated rows stay; null conversation ids form
one conversation; other columns are ignored.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
IMAGE, AUDIO, DOCUMENT = "<|image|>", "<|audio|>", "<|document|>"
#: What may start and end a control string, those of common templates included: <|...|>, <s>, </s>, [INST], [/INST].
_HEAD, _TAIL = r"([<\[])", r"(\||/?s>|/?INST\])"
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
#: Expanded tokens: an image by 28-pixel patches, audio by 25 frames a second, a document by its pages.
PATCH, FRAMES, PAGE_TOKENS = 28, 25, 256


def escape(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), _HEAD + r"(\\*)" + _TAIL, r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _HEAD + r"\\(\\*)" + _TAIL, "$1$2$3")


def text_part(text: Column) -> Column:
    """A text as a part, null as empty."""
    return F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), *(
        F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"),
                                                   ("seconds", "double"), ("pages", "int")))).cast(PART)


def _is_text(part: Column) -> Column:
    return ~F.coalesce(part["type"].isin("image", "audio", "document"), F.lit(False))


def _rendered(part: Column, run: Column) -> Column:
    """The placeholder of an attachment, or the escaped texts of the run that `part` begins."""
    kind = part["type"]
    marks = [F.when(kind == "image", F.lit(IMAGE)), F.when(kind == "audio", F.lit(AUDIO)),
             F.when(kind == "document", F.lit(DOCUMENT))]
    return F.coalesce(*marks, escape(F.array_join(run["text"], "")))


def _expanded(part: Column) -> Column:
    up = lambda x, size: F.ceil(F.coalesce(x, F.lit(0)) / size).cast("long")
    return (F.when(part["type"] == "image", up(part["width"], PATCH) * up(part["height"], PATCH))
            .when(part["type"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * FRAMES).cast("long"))
            .when(part["type"] == "document", F.coalesce(part["pages"], F.lit(0)).cast("long") * PAGE_TOKENS))


def visit(turns: DataFrame, parts_col: str = "parts") -> DataFrame:
    """Turns (conv_id, turn, role, parts) with `body`, the flattened parts, and `attachments`.

    An attachment has its type, reference, place in the body and expanded tokens.
    """
    parts = F.filter(F.coalesce(F.col(parts_col), F.expr(f"cast(array() as array<{PART}>)")), lambda p: p.isNotNull())
    # A piece is an attachment or a run of texts; these are the places (from 1) where one begins.
    borders = F.filter(F.transform("parts", lambda p, i: F.when(
        (i == 0) | ~_is_text(p) | ~_is_text(F.get("parts", i - 1)), i + 1)), lambda at: at.isNotNull())

    def piece(at, k):
        part = F.get("parts", at - 1)
        run = F.slice("parts", at, F.coalesce(F.get("borders", k + 1), F.size("parts") + 1) - at)
        return F.struct(part["type"].alias("type"), part["ref"].alias("ref"), _rendered(part, run).alias("body"),
                        _expanded(part).alias("tokens"))

    # The place of an attachment is the length of the pieces before it.
    start = F.expr(f"struct(cast(0 as long) as at, cast(array() as array<struct<type:string,ref:string,at:long,"
                   f"tokens:long>>) as found)")
    walked = F.aggregate("pieces", start, lambda s, p: F.struct(
        (s["at"] + F.length(p["body"])).alias("at"),
        F.when(p["tokens"].isNotNull(), F.concat(s["found"], F.array(F.struct(
            p["type"].alias("type"), p["ref"].alias("ref"), s["at"].alias("at"), p["tokens"].alias("tokens")))))
        .otherwise(s["found"]).alias("found")))["found"]
    return (turns.withColumn("parts", parts).withColumn("borders", borders)
            .withColumn("pieces", F.transform("borders", piece))
            .select("conv_id", "turn", "role", F.array_join(F.transform("pieces", lambda p: p["body"]), "").alias("body"),
                    walked.alias("attachments")))


def render(visited: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: formatted text, loss spans (start, length) and attachments.

    Turns are rendered before the shuffle; a conversation's turns then meet in
    one row, as its text is one value.
    """
    role = F.coalesce(F.col("role"), F.lit(""))
    piece = F.concat(F.lit(TURN), escape(role), F.lit(BODY), F.col("body"), F.lit(END))
    prepared = visited.select("conv_id", F.struct(
        F.col("turn"), role.alias("role"), piece.alias("piece"),
        (F.length(escape(role)) + len(TURN) + len(BODY)).alias("head"), F.length("body").alias("size"),
        "attachments").alias("t"))
    turns = prepared.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    start = F.expr("struct(cast(0 as long) as at, cast(array() as array<struct<start:long,length:long>>) as loss, "
                   "cast(array() as array<struct<type:string,ref:string,at:long,tokens:long>>) as files)")
    walked = F.aggregate("turns", start, lambda s, t: F.struct(
        (s["at"] + F.length(t["piece"])).alias("at"),
        F.when(t["role"] == loss_role, F.concat(s["loss"], F.array(F.struct(
            (s["at"] + t["head"]).alias("start"), t["size"].cast("long").alias("length")))))
        .otherwise(s["loss"]).alias("loss"),
        F.concat(s["files"], F.transform(t["attachments"], lambda a: F.struct(
            a["type"].alias("type"), a["ref"].alias("ref"), (s["at"] + t["head"] + a["at"]).alias("at"),
            a["tokens"].alias("tokens")))).alias("files")))
    return (turns.withColumn("walked", walked)
            .select("conv_id", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
                    F.col("walked.loss").alias("loss_spans"), F.col("walked.files").alias("attachments"),
                    F.aggregate("walked.files", F.lit(0).cast("long"), lambda n, a: n + a["tokens"])
                    .alias("attachment_tokens")))


def parse(formatted: Column) -> Column:
    """Read a formatted conversation back: array of (role, text), placeholders left in the text."""
    pieces = F.filter(F.split(formatted, r"<\|end\|>", -1), lambda p: F.length(p) > 0)
    return F.transform(pieces, lambda p: F.struct(
        unescape(F.substring_index(F.substring(p, len(TURN) + 1, 1 << 30), BODY, 1)).alias("role"),
        unescape(F.substring(p, F.instr(p, BODY) + len(BODY), F.lit(1 << 30))).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, in order, unescaped span by span."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(
        formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
