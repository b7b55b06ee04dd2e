"""DuckDB SQL with the results the registered queries must give."""

from advisoryspark import fixed_values as fx
from advisoryspark.sources.testview import PHRASES, WEAKNESSES

# A word boundary next to letters of any script.
_LEFT, _RIGHT = r"(^|[^\pL\pN_])", r"($|[^\pL\pN_])"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _pattern(pattern: str) -> str:
    parts = []
    for alternative in pattern.split("|"):
        if alternative.startswith("\\b"):
            alternative = _LEFT + alternative[2:]
        if alternative.endswith("\\b"):
            alternative = alternative[:-2] + _RIGHT
        parts.append(alternative)
    return _text("|".join(parts))


def _first_match(lowered: str, rules, default: str) -> str:
    whens = " ".join(f"WHEN regexp_matches({lowered}, {_pattern(p)}) THEN {_text(n)}" for n, p in rules)
    return f"CASE {whens} ELSE {_text(default)} END"


def _impact(lowered: str, rules) -> str:
    flags = ", ".join(f"CASE WHEN regexp_matches({lowered}, {_pattern(p)}) THEN {_text(n)} END" for n, p in rules)
    return f"coalesce(nullif(concat_ws(', ', {flags}), ''), 'Unknown')"


def _severity(score: str) -> str:
    return (f"CASE WHEN {score} IS NULL OR {score} = 0 THEN 'UNKNOWN' WHEN isnan({score}) THEN 'LOW' "
            f"WHEN {score} >= 9 THEN 'CRITICAL' WHEN {score} >= 7 THEN 'HIGH' "
            f"WHEN {score} >= 4 THEN 'MEDIUM' ELSE 'LOW' END")


def _state(score: str) -> str:
    return (f"CASE WHEN {score} < 4 THEN 'Low Threat' WHEN {score} < 7 THEN 'Medium Threat' "
            f"ELSE 'High Threat' END")


_YEAR = "CAST(2017 + CAST(floor(sqrt(doc_id % 100)) AS INT) AS VARCHAR)"
_ID = f"('CVE-' || {_YEAR} || '-' || CAST(doc_id + 1001 AS VARCHAR))"
_PHRASE = "list_extract([" + ", ".join(map(_text, PHRASES)) + "], CAST(doc_id % 16 + 1 AS INT))"
_CWE = "list_extract([" + ", ".join(map(_text, WEAKNESSES)) + "], CAST(doc_id % 4 + 1 AS INT))"

RAW = f"""raw AS (
  SELECT doc_id, {_ID} AS CVE_ID, {_PHRASE} || '. ' || text AS Description, {_YEAR} AS Year,
         CAST(doc_id * 37 % 101 AS DOUBLE) / 10 AS CVSS_Score, {_CWE} AS CWE, source AS OS
  FROM documents),
low AS (SELECT *, lower(Description) AS lo FROM raw)"""

_CLEAN = "trim(regexp_replace(lo, '[^a-z0-9]+', ' ', 'g'))"
_CONFIDENCE = "round(1 - least(0.4::DOUBLE, abs(CVSS_Score - 5.0::DOUBLE) / 10), 2)"
_EXPLOIT = _first_match("lo", fx.EXPLOIT_RULES, "Other")
_COMPONENT = _first_match("lo", fx.COMPONENT_RULES, "Unknown")
_OLD_COMPONENT = _first_match("lo", fx.RESEARCH_COMPONENT_RULES, "Unknown")

TAB = RAW + f""",
tab AS (
  SELECT doc_id, CVE_ID, Description, {_CLEAN} AS Cleaned_Description, Year, CVSS_Score, CWE, OS,
         {_EXPLOIT} AS Exploit_Type, {_COMPONENT} AS Affected_Component,
         {_impact('lo', fx.IMPACT_RULES)} AS Impact, {_severity('CVSS_Score')} AS True_Severity,
         'MEDIUM' AS Predicted_Severity, {_CONFIDENCE} AS Severity_Confidence,
         'N/A' AS BERT_Category, 0.0::DOUBLE AS BERT_Confidence
  FROM low)"""

TARGET = TAB + """,
target AS (SELECT * FROM tab WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)),
batch0 AS (
  SELECT tab.* EXCLUDE (CVSS_Score, True_Severity), v.seq,
         CASE WHEN v.seq = 2 THEN least(10.0::DOUBLE, CVSS_Score + toxic + 0.5) ELSE CVSS_Score END AS CVSS_Score
  FROM tab JOIN labels USING (doc_id), (VALUES (1), (2)) v(seq)),
batch AS (SELECT *, """ + _severity("CVSS_Score") + """ AS True_Severity FROM batch0)"""

PAIRS = RAW + f""",
pairs AS (
  SELECT CVE_ID, {_severity('CVSS_Score')} AS True_Severity,
         {_COMPONENT} AS new_label, {_OLD_COMPONENT} AS old_label FROM low)"""

STATES = RAW + f""",
states AS (
  SELECT CVE_ID, {_state('CVSS_Score')} AS state,
         lag({_state('CVSS_Score')}) OVER (ORDER BY Year, CVE_ID) AS prev_state FROM raw)"""


def _described(label: str) -> str:
    return f"CASE WHEN {label} = 'Unknown' THEN 'See description' ELSE {label} END"


PREDICTED = TAB + f""",
pred AS (
  SELECT CVE_ID, CWE, True_Severity AS severity, CVSS_Score AS cvss_score, Exploit_Type AS exploit_type,
         {_described('Affected_Component')} AS affected_component, {_described('Impact')} AS impact,
         CASE WHEN CVSS_Score > 0 THEN 85 ELSE 50 END AS confidence,
         'CVSS ' || CAST(CVSS_Score AS VARCHAR) || ' maps to ' || True_Severity || '. Pattern matched: '
           || Exploit_Type || '.' AS reasoning
  FROM tab)"""

_DAILY = """counts AS (
  SELECT event_type AS series, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS t, count(*) AS n
  FROM events GROUP BY ALL)"""


def _yearly(series: str) -> str:
    return TAB + f""",
counts AS (SELECT {series} AS series, CAST(Year AS INT) AS t, count(*) AS n FROM tab GROUP BY ALL)"""


_FITS = """,
fits AS (
  SELECT series, regr_slope(n, t) AS slope, regr_intercept(n, t) AS intercept, max(t) AS last_t,
         arg_max(n, t) AS last_n
  FROM counts GROUP BY series HAVING count(*) >= 3)"""

_ROUND1 = "round_even(({}) * 10, 0) / 10"


def _arima(steps: int) -> str:
    """Future periods with the line and the bisected AR(1) forecast."""
    return _FITS + f""",
diffs AS (
  SELECT series, t, n - lag(n) OVER w AS z, row_number() OVER w - 1 AS k FROM counts
  WINDOW w AS (PARTITION BY series ORDER BY t)),
pairs AS (
  SELECT series, t, CAST(z AS DOUBLE) AS z, lag(z) OVER (PARTITION BY series ORDER BY t) AS zb, k,
         max(k) OVER (PARTITION BY series) AS m FROM diffs WHERE k > 0),
sums AS (
  SELECT series, max(m) AS m, sum(z * z) AS c, sum(z * zb) AS b,
         sum(CASE WHEN k > 1 AND k < m THEN z * z ELSE 0 END) AS d, arg_max(z, k) AS last_z
  FROM pairs GROUP BY series HAVING max(m) >= 2),
bis(series, i, lo, hi) AS (
  SELECT series, 0, -1.0::DOUBLE, 1.0::DOUBLE FROM sums
  UNION ALL
  SELECT series, i + 1, CASE WHEN f < 0 THEN mid ELSE lo END, CASE WHEN f < 0 THEN hi ELSE mid END
  FROM (SELECT s.series, i, lo, hi, (lo + hi) / 2 AS mid,
               ((((1 - m) * d * ((lo + hi) / 2) + (m - 2) * b) * ((lo + hi) / 2) + (c + m * d))
                 * ((lo + hi) / 2) - m * b) AS f
        FROM bis JOIN sums s USING (series) WHERE i < 60)),
phis AS (
  SELECT series, last_z, CASE WHEN c > 0 THEN (lo + hi) / 2 END AS phi
  FROM bis JOIN sums USING (series) WHERE i = 60),
future AS (
  SELECT fits.series, last_t + step AS t, step, intercept + slope * (last_t + step) AS line,
         last_n + last_z * CASE WHEN phi = 1 THEN step ELSE phi * (1 - phi ** step) / (1 - phi) END AS moved
  FROM fits LEFT JOIN phis USING (series), (SELECT unnest(range(1, {steps + 1})) AS step)),
fc AS (
  SELECT series, t, step, {_ROUND1.format('line')} AS linear_prediction,
         round_even(coalesce(moved, line), 0) AS arima_prediction FROM future)"""


_TREND = f"""SELECT series, t, n AS actual, {_ROUND1.format('intercept + slope * t')} AS linear_trend
FROM counts JOIN fits USING (series)"""

_TFIDF = TAB + """,
terms AS (
  SELECT CVE_ID, term, count(*) AS tf
  FROM (SELECT CVE_ID, unnest(string_split(Cleaned_Description, ' ')) AS term FROM tab)
  WHERE length(term) >= 2 GROUP BY ALL),
vocab AS (
  SELECT term, count(*) AS df, sum(tf) AS total FROM terms GROUP BY term
  ORDER BY total DESC, term LIMIT 100)"""


def _with(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"


def _rec(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes}\n{select}"


def _hash32(key: str) -> str:
    return f"CAST(('0x' || substr(md5(CAST({key} AS VARCHAR) || '#42'), 1, 8)) AS BIGINT)"


def _histogram(source: str, column: str) -> str:
    return f"""s AS (SELECT min({column}) AS lo, (max({column}) - min({column})) / 10 AS w, avg({column}) AS mean FROM {source}),
b0 AS (SELECT {column} AS x, lo, w, CAST(least(floor(({column} - lo) / w), 9) AS INT) AS b FROM {source}, s),
b1 AS (SELECT CASE WHEN x < lo + b * w THEN b - 1 WHEN b < 9 AND x >= lo + b * w + w THEN b + 1 ELSE b END AS bin FROM b0),
frame AS (SELECT CAST(i AS INT) AS bin, round(lo + i * w, 6) AS bin_start, round(lo + (i + 1) * w, 6) AS bin_end,
                 round(mean, 4) AS mean FROM range(10) r(i), s)"""


_HISTOGRAM = """SELECT frame.bin, bin_start, bin_end, coalesce(n, 0) AS n, mean
FROM frame LEFT JOIN (SELECT bin, count(*) AS n FROM b1 GROUP BY bin) c USING (bin)"""


def _count(column: str) -> str:
    return _with(TAB, f"SELECT {column}, count(*) AS n FROM tab GROUP BY {column}")


def _prompt() -> str:
    head, *tails = fx.PROMPT_FORMAT.split("%s")
    values = ["CVE_ID", "Description", "CAST(CVSS_Score AS VARCHAR)", "CWE", "Year"]
    return _text(head) + "".join(f" || {v} || {_text(t)}" for v, t in zip(values, tails))


_PIVOT = ", ".join(f"count(*) FILTER (Exploit_Type = {_text(n)}) AS {chr(34)}{n}{chr(34)}" for n, _ in fx.EXPLOIT_RULES)

_OBSERVED = RAW + """,
seq AS (
  SELECT CVE_ID, Year, CVSS_Score AS x, row_number() OVER (ORDER BY Year, CVE_ID) AS t,
         CASE WHEN CVSS_Score < 4 THEN 1 WHEN CVSS_Score < 7 THEN 2 ELSE 3 END AS s FROM raw),
mom AS (
  SELECT s, avg(x) AS m, var_pop(x) AS v, ln(count(*) / (SELECT count(*) FROM seq)) AS lp FROM seq GROUP BY s),
mv AS (
  SELECT p, s, ln(n / sum(n) OVER (PARTITION BY p)) AS la FROM (
    SELECT p, s, count(*) AS n FROM (SELECT s, lag(s) OVER (ORDER BY t) AS p FROM seq) WHERE p IS NOT NULL GROUP BY ALL))"""

_SUMMARY = """SELECT 'total' AS dimension, 'all' AS key, count(*) AS n,
round(avg(CVSS_Score), 2) AS avg_cvss FROM tab
UNION ALL SELECT 'severity', True_Severity, count(*), NULL FROM tab GROUP BY ALL
UNION ALL SELECT 'exploit', Exploit_Type, count(*), NULL FROM tab GROUP BY ALL
UNION ALL SELECT 'year', Year, count(*), NULL FROM tab GROUP BY ALL
UNION ALL (SELECT 'component', Affected_Component, count(*) AS c, NULL FROM tab GROUP BY ALL
ORDER BY c DESC, Affected_Component LIMIT 10)"""

_CHANGED = TAB + f""",
tab0 AS (SELECT * REPLACE (CASE WHEN doc_id % 3 = 0 THEN round(10 - CVSS_Score, 1) ELSE CVSS_Score END AS CVSS_Score)
  FROM tab WHERE doc_id % 5 <> 4),
tab1 AS (SELECT * REPLACE ({_severity('CVSS_Score')} AS True_Severity) FROM tab0)"""

_LIVE = f"""SELECT *, 0 AS epoch FROM ({_SUMMARY.replace("FROM tab", "FROM tab1")})
UNION ALL SELECT *, 1 FROM ({_SUMMARY})"""

_TERMS = ["In_ection", "worthless", "sql%panel", "é", "CVE-2019-10", "no such text"]

_GREEDY = f""",
par AS (
  SELECT {", ".join(f"coalesce((SELECT la FROM mv WHERE p = {i} AND s = {j}), '-Infinity'::DOUBLE) AS a{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3))},
         {", ".join(f"(SELECT m FROM mom WHERE s = {j}) AS m{j}" for j in (1, 2, 3))},
         (SELECT sum(exp(lp) * v) FROM mom) AS v),
path(t, k) AS (
  SELECT t, s FROM seq WHERE t = 1
  UNION ALL
  SELECT t, CASE greatest(l1, l2, l3) WHEN l1 THEN 1 WHEN l2 THEN 2 ELSE 3 END FROM (
    SELECT seq.t, {", ".join(f"m{j} / v * x + CASE k WHEN 1 THEN a1{j} WHEN 2 THEN a2{j} ELSE a3{j} END - m{j} ** 2 / (2 * v) AS l{j}" for j in (1, 2, 3))}
    FROM path JOIN seq ON seq.t = path.t + 1, par))"""


def _folded(n: int) -> str:
    """List of n sums over the whole embedding, value i counting for sum i modulo n."""
    return (f"[CAST(coalesce(list_sum([CAST(round(CAST(embedding[i] AS DOUBLE) * 1000000) AS BIGINT) "
            f"FOR i IN range(1, len(embedding) + 1) IF (i - 1) % {n} = k]), 0) AS DOUBLE) / 1000000 FOR k IN range({n})]")


def _em_step() -> str:
    """Forward-backward over the sequence from the start model, then the new parameters."""
    j3, ij = (1, 2, 3), [(i, j) for i in (1, 2, 3) for j in (1, 2, 3)]
    return RAW + f""",
seq AS (SELECT CVSS_Score AS x, row_number() OVER (ORDER BY Year, CVE_ID) AS t FROM raw),
ranked AS (SELECT x, row_number() OVER (ORDER BY x) AS r, count(*) OVER () AS n FROM seq),
par AS (
  SELECT {", ".join(f"min(x) FILTER (r >= n * {q}.0 / 6 - 1e-9) AS m{j}" for j, q in zip(j3, (1, 3, 5)))},
         var_pop(x) + 0.01 AS v FROM ranked),
dens AS (
  SELECT t, x, {", ".join(f"exp(-0.5 * (x - m{j}) ** 2 / v) / sqrt(2 * pi() * v) AS b{j}" for j in j3)} FROM seq, par),
fw(t, f1, f2, f3, c) AS (
  SELECT t, b1 / (b1 + b2 + b3), b2 / (b1 + b2 + b3), b3 / (b1 + b2 + b3), (b1 + b2 + b3) / 3 FROM dens WHERE t = 1
  UNION ALL
  SELECT d.t, b1 / (b1 + b2 + b3), b2 / (b1 + b2 + b3), b3 / (b1 + b2 + b3), (f1 + f2 + f3) * (b1 + b2 + b3) / 3
  FROM fw JOIN dens d ON d.t = fw.t + 1),
bw(t, g1, g2, g3) AS (
  SELECT max(t), 1.0::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE FROM dens
  UNION ALL
  SELECT bw.t - 1, {", ".join("(b1 * g1 + b2 * g2 + b3 * g3) / 3 / c" for _ in j3)}
  FROM bw JOIN dens d USING (t) JOIN fw USING (t) WHERE bw.t > 1),
both_ways AS (SELECT t, x, {", ".join(f"b{j}, f{j}, g{j}, f{j} * g{j} AS w{j}" for j in j3)}, c
  FROM dens JOIN fw USING (t) JOIN bw USING (t)),
moved AS (SELECT *, {", ".join(f"lag(f{j}) OVER (ORDER BY t) AS p{j}" for j in j3)} FROM both_ways),
sums AS (
  SELECT {", ".join(f"sum(w{j}) AS n{j}, sum(w{j} * x) AS s{j}, sum(w{j} * x * x) AS q{j}" for j in j3)},
         {", ".join(f"sum(p{i} / 3 * b{j} * g{j} / c) AS k{i}{j}" for i, j in ij)}, sum(ln(c)) AS ll,
         {", ".join(f"max(w{j}) FILTER (t = 1) AS a{j}" for j in j3)} FROM moved)"""


_EM_RESULT = "SELECT " + ", ".join(
    [f"round(s{j} / n{j}, 6) AS means_{j - 1}" for j in (1, 2, 3)]
    + [f"round((0.01 + q{j} - n{j} * (s{j} / n{j}) ** 2) / n{j}, 6) AS variances_{j - 1}" for j in (1, 2, 3)]
    + [f"round(a{j} / (a1 + a2 + a3), 6) AS startprob_{j - 1}" for j in (1, 2, 3)]
    + [f"round(k{i}{j} / (k{i}1 + k{i}2 + k{i}3), 6) AS transmat_{3 * i + j - 4}" for i in (1, 2, 3) for j in (1, 2, 3)]
    + ["round(ll, 6) AS log_likelihood FROM sums"])

_MODELLED = TAB + f""",
means AS (SELECT CWE, round(avg(CVSS_Score), 1) AS p FROM raw GROUP BY CWE),
mod AS (
  SELECT doc_id, CVE_ID, Year, Description, p, {_severity('p')} AS Predicted_Severity,
         round(1 - least(0.4::DOUBLE, abs(CVSS_Score - p) / 10), 2) AS Severity_Confidence,
         CASE WHEN length(Description) > 1000 THEN 'LABEL_1' ELSE 'LABEL_0' END AS BERT_Category,
         round(length(Description) / (length(Description) + 1000), 3) AS BERT_Confidence
  FROM tab JOIN means USING (CWE)),
guessed AS (
  SELECT CVE_ID, v FROM (SELECT CVE_ID, [n / (1 + list_sum(c)) FOR n IN c] AS v FROM (
    SELECT CVE_ID, [(length(lo) - length(replace(lo, word, ''))) // length(word)
                    FOR word IN ['critical', 'high', 'medium', 'low']] AS c FROM low)))"""
_GUESS = """list_extract(['CRITICAL', 'HIGH', 'MEDIUM', 'LOW'], list_position(v, list_max(v)))"""
_LOW_IDS = "SELECT doc_id FROM labels WHERE quality = 0"

ORACLES = {
    "hmm_em_step": _rec(_em_step(), _EM_RESULT),
    "enrich_models": _with(_MODELLED, "SELECT CVE_ID, Predicted_Severity, Severity_Confidence, BERT_Category, BERT_Confidence FROM mod"),
    "lookup_models": _with(_MODELLED, f"""SELECT CVE_ID, CASE WHEN fresh THEN 'feed' ELSE 'local_database' END AS source,
CASE WHEN fresh THEN Predicted_Severity ELSE 'MEDIUM' END AS Predicted_Severity,
CASE WHEN fresh THEN BERT_Category ELSE 'N/A' END AS BERT_Category,
CASE WHEN fresh THEN {_GUESS} END AS zero_shot_severity, CASE WHEN fresh THEN round(list_max(v), 3) END AS zero_shot_confidence
FROM (SELECT *, doc_id IN ({_LOW_IDS}) AS fresh FROM mod JOIN guessed USING (CVE_ID))"""),
    "lookup_stored": _with(_MODELLED, f"""SELECT CVE_ID, CASE WHEN fresh THEN 'feed' ELSE 'local_database' END AS source,
CASE WHEN fresh THEN Predicted_Severity ELSE 'MEDIUM' END AS Predicted_Severity
FROM (SELECT *, doc_id IN ({_LOW_IDS}) AS fresh FROM mod)"""),
    "pages_by_key": _with(TAB, """SELECT CVE_ID, Year FROM tab
WHERE CVE_ID ILIKE '%kernel%' OR Description ILIKE '%kernel%' OR Affected_Component ILIKE '%kernel%'
ORDER BY Year DESC, CVE_ID DESC LIMIT 25 OFFSET 25"""),
    "head_rows": _with(TAB, "SELECT CVE_ID, Year, Impact FROM tab ORDER BY Year, CVE_ID LIMIT 50"),
    "seeded_table": _with(TAB, f"""SELECT True_Severity, count(*) AS n FROM (
  SELECT CVE_ID, True_Severity FROM tab
  UNION ALL SELECT CVE_ID, True_Severity FROM (VALUES {", ".join(f"({_text(r[0])}, {_text(r[-1])})" for r in fx.SEED_RECORDS)})
    s(CVE_ID, True_Severity) WHERE CVE_ID NOT IN (SELECT CVE_ID FROM tab)) GROUP BY ALL"""),
    "reset_table": _with(TAB, f"""SELECT CVE_ID, Year FROM tab
WHERE CVE_ID NOT IN ({", ".join(_text(r[0]) for r in fx.SEED_RECORDS)})"""),
    "older_table": _with(TAB, "SELECT CVE_ID, Impact, NULL::VARCHAR AS BERT_Category, NULL::DOUBLE AS BERT_Confidence FROM tab"),
    "prediction_log": _with(_MODELLED, """SELECT 'v1' AS model_version, 'MEDIUM' AS Predicted_Severity, count(*) AS n FROM tab
UNION ALL SELECT 'v2', Predicted_Severity, count(*) FROM mod GROUP BY ALL"""),
    "oof_folds": _with(TAB, """SELECT CVE_ID, CAST(CASE WHEN i < extra * (size + 1) THEN i // (size + 1)
  ELSE extra + (i - extra * (size + 1)) // size END AS INT) AS fold
FROM (SELECT CVE_ID, row_number() OVER (ORDER BY Year, CVE_ID) - 1 AS i, count(*) OVER () // 3 AS size,
             count(*) OVER () % 3 AS extra FROM tab)"""),
    "rf_score_range": _with(TAB, "SELECT CVE_ID, true AS score_fits, true AS severity_fits, true AS confidence_fits FROM tab"),
    "text_classifier_range": _with(TAB, "SELECT CVE_ID, true AS label_fits, true AS confidence_fits FROM tab"),
    "record_report_models": _with(_MODELLED, f"""SELECT CVE_ID AS cve_id, BERT_Category AS bert_category,
BERT_Confidence AS bert_confidence, {_GUESS} AS zero_shot_severity, round(list_max(v), 3) AS zero_shot_confidence,
p AS rf_predicted_cvss, Predicted_Severity AS rf_predicted_severity
FROM mod JOIN guessed USING (CVE_ID) WHERE CVE_ID = 'CVE-2019-1007'"""),
    "tfidf_unseen": _with(TAB + """,
terms AS (
  SELECT CVE_ID, Year, term, count(*) AS tf
  FROM (SELECT CVE_ID, Year, unnest(string_split(Cleaned_Description, ' ')) AS term FROM tab)
  WHERE length(term) >= 2 GROUP BY ALL),
vocab AS (
  SELECT term, count(*) AS df, sum(tf) AS total FROM terms WHERE Year < '2023' GROUP BY term
  ORDER BY total DESC, term LIMIT 100),
w AS (
  SELECT CVE_ID, term, tf * (ln((1 + (SELECT count(*) FROM tab WHERE Year < '2023')) / (1 + df)) + 1) AS v
  FROM terms JOIN vocab USING (term) WHERE Year >= '2023')""",
        """SELECT CVE_ID, term, round(v / sqrt(sum(v * v) OVER (PARTITION BY CVE_ID)), 6) AS weight FROM w"""),
    "feed_fallbacks": _with(RAW, f"""SELECT CVE_ID, CASE WHEN k = 9 THEN {_text(fx.DEFAULT_DESCRIPTION)} ELSE Description END AS Description,
CASE WHEN k < 4 THEN CVSS_Score WHEN k < 6 THEN CVSS_Score + 0.25 WHEN k < 8 THEN CVSS_Score + 0.5 ELSE 0 END AS CVSS_Score,
CASE WHEN k % 2 = 0 THEN CWE ELSE 'N/A' END AS CWE FROM (SELECT *, CAST(right(CVE_ID, 1) AS INT) AS k FROM raw)"""),
    "clean_text": _with(RAW, f"SELECT CVE_ID, {_CLEAN} AS Cleaned_Description FROM low"),
    "token_stats": _with(RAW, f"""SELECT OS, count(*) AS n, CAST(sum(c) AS BIGINT) AS tokens, CAST(max(c) AS BIGINT) AS longest,
round(avg(c), 4) AS mean_tokens
FROM (SELECT OS, len(list_filter(string_split({_CLEAN}, ' '), lambda x: x <> '')) AS c FROM low) GROUP BY OS"""),
    "exploit_labels": _with(RAW, f"SELECT CVE_ID, {_EXPLOIT} AS Exploit_Type FROM low"),
    "component_labels": _with(RAW, f"SELECT CVE_ID, {_COMPONENT} AS Affected_Component FROM low"),
    "impact_labels": _with(RAW, f"SELECT CVE_ID, {_impact('lo', fx.IMPACT_RULES)} AS Impact FROM low"),
    "research_rules_labels": _with(RAW, f"""SELECT CVE_ID, {_first_match('lo', fx.RESEARCH_EXPLOIT_RULES, 'Other')} AS Exploit_Type,
{_OLD_COMPONENT} AS Affected_Component, {_impact('lo', fx.RESEARCH_IMPACT_RULES)} AS Impact FROM low"""),
    "page_component_labels": f"""SELECT page_id, {_COMPONENT} AS component, {_impact('lo', fx.IMPACT_RULES)} AS impact
FROM (SELECT page_id, lower(html) AS lo FROM pages)""",
    "severity_labels": _with(RAW, f"SELECT CVE_ID, CVSS_Score, {_severity('CVSS_Score')} AS severity FROM raw"),
    "threat_states": _with(RAW, f"""SELECT CVE_ID, state, CAST(state = 'Low Threat' AS DOUBLE) AS is_low,
CAST(state = 'Medium Threat' AS DOUBLE) AS is_medium, CAST(state = 'High Threat' AS DOUBLE) AS is_high
FROM (SELECT CVE_ID, {_state('CVSS_Score')} AS state FROM raw)"""),
    "score_confidence": _with(RAW, """SELECT CVE_ID, predicted,
round(1 - least(0.4::DOUBLE, abs(CVSS_Score - predicted) / 10), 2) AS confidence
FROM raw JOIN (SELECT CWE, round(avg(CVSS_Score), 1) AS predicted FROM raw GROUP BY CWE) USING (CWE)"""),
    "id_validation": _with(RAW, """SELECT CVE_ID, true AS is_valid FROM raw
UNION ALL SELECT 'CVE-20-' || CAST(c_custkey AS VARCHAR), false FROM customer"""),
    "year_from_id": _with(RAW, """SELECT CVE_ID, coalesce(nullif(regexp_extract(CVE_ID, 'CVE-(\\d{4})-', 1), ''), 'Unknown') AS Year
FROM (SELECT CVE_ID FROM raw UNION ALL SELECT 'CVE-20-' || CAST(c_custkey AS VARCHAR) FROM customer)"""),
    "order_years_published": """SELECT strftime(o_orderdate, '%Y') AS Year, count(*) AS n FROM orders GROUP BY ALL""",
    "rule_predictions": _with(PREDICTED, "SELECT * EXCLUDE (CWE) FROM pred"),
    "prompt_render": _with(RAW, f"SELECT CVE_ID, {_prompt()} AS prompt FROM raw"),
    "reply_parse": _with(PREDICTED, """SELECT CVE_ID, CASE WHEN ok THEN severity END AS severity,
CASE WHEN ok THEN cvss_score END AS cvss_score, CASE WHEN ok THEN exploit_type END AS exploit_type,
CASE WHEN ok THEN affected_component END AS affected_component, CASE WHEN ok THEN impact END AS impact,
CASE WHEN ok THEN CAST(confidence AS DOUBLE) END AS confidence, CASE WHEN ok THEN reasoning END AS reasoning
FROM (SELECT *, CWE <> 'N/A' AS ok FROM pred)"""),
    "report_excerpts": _with(TAB, """SELECT CVE_ID, substr(Description, 1, 120) || '...' AS raw_excerpt,
substr(Cleaned_Description, 1, 120) || '...' AS cleaned_excerpt FROM tab"""),
    "zero_shot_labels": f"""SELECT vec_id, upper(replace(list_extract(['critical severity', 'high severity', 'medium severity',
'low severity'], list_position(four, list_max(four))), ' severity', '')) AS label,
round(list_max(four), 3) AS score
FROM (SELECT vec_id, {_folded(4)} AS four FROM embeddings)""",
    "enrich_rules": _with(TAB, "SELECT * EXCLUDE (doc_id) FROM tab"),
    "research_storage": _count("Exploit_Type"),
    "lookup_with_source": _with(TARGET, """SELECT CVE_ID, Exploit_Type, True_Severity,
CASE WHEN CVE_ID IN (SELECT CVE_ID FROM target) THEN 'local_database' ELSE 'feed' END AS source FROM tab"""),
    "batch_predict_join": _with(PREDICTED, """SELECT CVE_ID, cvss_score AS CVSS_Score, severity AS True_Severity,
severity AS AI_Severity, exploit_type AS AI_Exploit_Type, affected_component AS AI_Component,
confidence AS AI_Confidence, impact AS AI_Impact FROM pred"""),
    "label_join": _with(TAB, "SELECT CVE_ID, Exploit_Type, quality, toxic FROM tab LEFT JOIN labels USING (doc_id)"),
    "search_filter": _with(TAB, """SELECT CVE_ID, True_Severity, Exploit_Type FROM tab WHERE True_Severity = 'HIGH'
AND (CVE_ID ILIKE '%In_ection%' OR Description ILIKE '%In_ection%' OR Affected_Component ILIKE '%In_ection%')"""),
    "exploit_filter": _with(TAB, "SELECT CVE_ID, Year, Exploit_Type FROM tab WHERE Exploit_Type = 'DoS'"),
    "page_listing": _with(TAB, """SELECT CVE_ID, Year, CVSS_Score, Affected_Component FROM tab
WHERE CVE_ID ILIKE '%kernel%' OR Description ILIKE '%kernel%' OR Affected_Component ILIKE '%kernel%'
ORDER BY Year DESC, CVE_ID DESC LIMIT 25 OFFSET 25"""),
    "page_envelope": _with(TAB, """SELECT count(*) AS total, 26::BIGINT AS start_row, least(count(*), 50) AS end_row,
true AS has_prev, least(count(*), 50) < count(*) AS has_next FROM tab
WHERE CVE_ID ILIKE '%kernel%' OR Description ILIKE '%kernel%' OR Affected_Component ILIKE '%kernel%'"""),
    "exact_lookup": _with(TAB, "SELECT CVE_ID, Description, Impact FROM tab WHERE CVE_ID = 'CVE-2019-1007'"),
    "ordered_scan": _with(RAW, "SELECT CVE_ID, CVSS_Score, Year FROM raw ORDER BY Year, CVE_ID"),
    "shuffled_sample": f"SELECT doc_id, lang FROM documents ORDER BY {_hash32('doc_id')}, doc_id LIMIT 800",
    "dataset_split": f"""SELECT doc_id, CAST(h % 100 AS INT) AS bucket,
CASE WHEN h % 100 < 80 THEN 'train' WHEN h % 100 < 90 THEN 'validation' ELSE 'test' END AS part
FROM (SELECT doc_id, {_hash32('doc_id')} AS h FROM documents)""",
    "kpi_summary": _with(TAB, """SELECT count(*) AS total, coalesce(round(avg(CVSS_Score), 2), 0.0::DOUBLE) AS avg_cvss,
count(*) FILTER (True_Severity IN ('HIGH', 'CRITICAL')) AS high_critical FROM tab"""),
    "severity_counts": _count("True_Severity"),
    "exploit_counts": _count("Exploit_Type"),
    "top_components": _with(TAB, """SELECT Affected_Component, count(*) AS n FROM tab
GROUP BY ALL ORDER BY n DESC, Affected_Component LIMIT 10"""),
    "component_share": _with(TAB, """SELECT Affected_Component, count(*) AS n,
round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 1) AS percent FROM tab GROUP BY ALL"""),
    "yearly_counts": _count("Year"),
    "stats_grouping_sets": _with(TAB, _SUMMARY),
    "year_exploit_pivot": _with(TAB, f"SELECT Year, {_PIVOT} FROM tab WHERE Exploit_Type <> 'Other' GROUP BY Year"),
    "score_bins": _with(RAW, """SELECT CAST(i AS INT) AS bin, coalesce(n, 0) AS n FROM range(10) r(i)
LEFT JOIN (SELECT floor(least(9.9, CVSS_Score)) AS b, count(*) AS n FROM raw GROUP BY b) ON b = i"""),
    "score_histogram": _with(RAW + ", " + _histogram("raw", "CVSS_Score"), _HISTOGRAM),
    "price_histogram": _with(_histogram("lineitem", "l_extendedprice"), _HISTOGRAM),
    "error_metrics": _with(TAB, """SELECT round(avg(abs(CVSS_Score - p)), 6) AS mae,
round(sqrt(avg((CVSS_Score - p) * (CVSS_Score - p))), 6) AS rmse, count(*) AS n
FROM tab JOIN (SELECT Exploit_Type, round(avg(CVSS_Score), 1) AS p FROM tab GROUP BY ALL) USING (Exploit_Type)"""),
    "class_report": _with(PAIRS + """,
cls AS (
  SELECT label, sum(s) AS support, sum(c) AS claimed, sum(h) AS hits FROM (
    SELECT new_label AS label, 1 AS s, 0 AS c, CAST(new_label = old_label AS INT) AS h FROM pairs
    UNION ALL SELECT old_label, 0, 1, 0 FROM pairs) GROUP BY label),
m AS (
  SELECT label, CASE WHEN claimed > 0 THEN hits / claimed ELSE 0 END AS precision,
         CASE WHEN support > 0 THEN hits / support ELSE 0 END AS recall,
         2 * hits / (claimed + support) AS f1, support, hits FROM cls),
al AS (
  SELECT label, precision, recall, f1, support FROM m
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM m
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                   sum(f1 * support) / sum(support), sum(support) FROM m
  UNION ALL SELECT 'accuracy', sum(hits) / sum(support), sum(hits) / sum(support), sum(hits) / sum(support),
                   sum(support) FROM m)""",
        """SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
CAST(support AS BIGINT) AS support FROM al"""),
    "label_accuracy": _with(PAIRS, """SELECT round(avg(CAST(new_label = old_label AS INT)), 6) AS accuracy, count(*) AS n FROM pairs"""),
    "label_comparison": _with(PAIRS, """SELECT CVE_ID, True_Severity, new_label AS first_label, old_label AS second_label,
new_label = old_label AS agree FROM pairs"""),
    "live_status": _with(_CHANGED, _LIVE),
    "keyed_merge": _with(TARGET, """SELECT CVE_ID, CVSS_Score, True_Severity FROM target
WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT CVE_ID, CVSS_Score, True_Severity FROM (
  SELECT *, row_number() OVER (PARTITION BY CVE_ID ORDER BY seq DESC) AS rn FROM batch) WHERE rn = 1"""),
    "keyed_lookup": _with(TAB, "SELECT CVE_ID, Exploit_Type, CVSS_Score FROM tab WHERE doc_id IN (SELECT doc_id FROM labels)"),
    "indexed_search": _with(TAB, " UNION ALL ".join(
        f"SELECT {_text(t)} AS term, CVE_ID FROM tab WHERE CVE_ID ILIKE '%{t}%' OR Description ILIKE '%{t}%' "
        f"OR Affected_Component ILIKE '%{t}%'" for t in _TERMS)),
    "upsert_merge": _with(TARGET, """SELECT CVE_ID, CVSS_Score, True_Severity, Exploit_Type FROM target
WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT CVE_ID, CVSS_Score, True_Severity, Exploit_Type FROM (
  SELECT *, row_number() OVER (PARTITION BY CVE_ID ORDER BY seq DESC) AS rn FROM batch) WHERE rn = 1"""),
    "insert_new_only": _with(TARGET, """SELECT CVE_ID, CVSS_Score, True_Severity FROM (
  SELECT *, row_number() OVER (PARTITION BY CVE_ID ORDER BY seq) AS rn FROM batch)
WHERE rn = 1 AND CVE_ID NOT IN (SELECT CVE_ID FROM target)"""),
    "write_defaults": _with(TAB, """SELECT CVE_ID, Cleaned_Description, True_Severity AS Predicted_Severity,
1.0::DOUBLE AS Severity_Confidence, 'N/A' AS BERT_Category, 0.0::DOUBLE AS BERT_Confidence FROM tab"""),
    "chronological_index": _with(RAW, """SELECT CVE_ID, Year, row_number() OVER (ORDER BY Year, CVE_ID) AS position FROM raw"""),
    "prev_state": _with(STATES, "SELECT CVE_ID, state, prev_state FROM states WHERE prev_state IS NOT NULL"),
    "transition_matrix": _with(STATES, """SELECT prev_state, state, n, round(n / sum(n) OVER (PARTITION BY prev_state), 6) AS probability
FROM (SELECT prev_state, state, count(*) AS n FROM states WHERE prev_state IS NOT NULL GROUP BY ALL)"""),
    "last_observation": _with(RAW, f"""SELECT CVE_ID, Year, CVSS_Score, {_state('CVSS_Score')} AS state FROM raw
ORDER BY Year DESC, CVE_ID DESC LIMIT 1"""),
    "yearly_difference": _with(_yearly("'all'"), "SELECT series, t, n, n - lag(n) OVER (ORDER BY t) AS diff FROM counts"),
    "linear_trend": _with(_yearly("'all'") + _FITS, _TREND),
    "linear_forecast": _rec(_yearly("'all'") + _arima(2), "SELECT series, t, linear_prediction FROM fc"),
    "forecast_yearly": _rec(_yearly("'all'") + _arima(2), "SELECT series, t, linear_prediction, arima_prediction FROM fc"),
    "arima110_forecast": _rec(_DAILY + _arima(5), "SELECT series, t, step, arima_prediction FROM fc"),
    "trend_by_exploit": _with(_yearly("Exploit_Type") + _FITS, _TREND),
    "forecast_by_exploit": _rec(_yearly("Exploit_Type") + _arima(2), "SELECT series, t, linear_prediction, arima_prediction FROM fc"),
    "forecast_display": _rec(_DAILY + _arima(2), f"""SELECT series, t, n AS actual, {_ROUND1.format('intercept + slope * t')} AS linear,
CASE WHEN t = last_t THEN CAST(n AS DOUBLE) END AS arima FROM counts JOIN fits USING (series)
UNION ALL SELECT series, t, NULL, linear_prediction, arima_prediction FROM fc"""),
    "tfidf_vocabulary": _with(_TFIDF, "SELECT term, CAST(total AS BIGINT) AS total, df FROM vocab"),
    "tfidf_weights": _with(_TFIDF + """,
w AS (
  SELECT CVE_ID, term, tf * (ln((1 + (SELECT count(*) FROM tab)) / (1 + df)) + 1) AS v
  FROM terms JOIN vocab USING (term))""",
        """SELECT CVE_ID, term, round(v / sqrt(sum(v * v) OVER (PARTITION BY CVE_ID)), 6) AS weight FROM w"""),
    "latest_predictions": _with(_MODELLED, """SELECT CVE_ID, Year, Predicted_Severity, Severity_Confidence FROM mod
WHERE Predicted_Severity = 'MEDIUM' ORDER BY Year DESC, CVE_ID DESC LIMIT 50"""),
    "status_report": _with(TAB + f""",
errors AS (
  SELECT round(round(avg(abs(CVSS_Score - p)), 6), 3) AS rf_mae,
         round(round(sqrt(avg((CVSS_Score - p) * (CVSS_Score - p))), 6), 3) AS rf_rmse
  FROM tab JOIN (SELECT Exploit_Type, round(avg(CVSS_Score), 1) AS p FROM tab GROUP BY ALL) USING (Exploit_Type)),
states AS (
  SELECT {_state('CVSS_Score')} AS state, lag({_state('CVSS_Score')}) OVER (ORDER BY Year, CVE_ID) AS prev_state FROM tab),
acc AS (
  SELECT round(100.0::DOUBLE * sum(hits) / sum(n), 1) AS memm_accuracy FROM (
    SELECT max(c) AS hits, sum(c) AS n FROM (
      SELECT prev_state, count(*) AS c FROM states WHERE prev_state IS NOT NULL GROUP BY prev_state, state)
    GROUP BY prev_state)),
s AS ({_SUMMARY})""", "SELECT * FROM s, errors, acc"),
    "category_inference": _with(RAW, """SELECT CVE_ID, CASE WHEN n > 1000 THEN 'LABEL_1' ELSE 'LABEL_0' END AS BERT_Category,
round(n / (n + 1000), 3) AS BERT_Confidence FROM (SELECT CVE_ID, length(Description) AS n FROM raw)"""),
    "zero_shot_inference": _with(RAW + """,
w AS (
  SELECT CVE_ID, [(length(lo) - length(replace(lo, word, ''))) // length(word)
                  FOR word IN ['critical', 'high', 'medium', 'low']] AS c FROM low),
v AS (SELECT CVE_ID, [n / (1 + list_sum(c)) FOR n IN c] AS v FROM w)""",
        """SELECT CVE_ID, list_extract(['CRITICAL', 'HIGH', 'MEDIUM', 'LOW'], list_position(v, list_max(v))) AS zero_shot_severity,
round(list_max(v), 3) AS zero_shot_confidence FROM v"""),
    "token_sequences": _with(TAB + """,
words AS (
  SELECT CVE_ID, generate_subscripts(t, 1) AS place, unnest(t) AS token
  FROM (SELECT CVE_ID, list_filter(string_split(Cleaned_Description, ' '), lambda x: x <> '') AS t FROM tab)),
vocab AS (
  SELECT token, 1 + row_number() OVER (ORDER BY n DESC, token) AS token_id
  FROM (SELECT token, count(*) AS n FROM words GROUP BY token) QUALIFY token_id <= 30001),
ids AS (
  SELECT CVE_ID, list(coalesce(token_id, 1) ORDER BY place) AS ids
  FROM words LEFT JOIN vocab USING (token) WHERE place <= 128 GROUP BY CVE_ID)""",
        """SELECT CVE_ID, CAST(len(list_filter(ids, lambda i: i = 1)) AS INT) AS n_unknown,
array_to_string(list_resize(ids, 128, 0), ' ') AS input_ids,
array_to_string(list_resize([1 FOR i IN ids], 128, 0), ' ') AS attention_mask FROM ids"""),
    "hmm_path_observed": _rec(_OBSERVED + f""",
par AS (
  SELECT {", ".join(f"coalesce((SELECT la FROM mv WHERE p = {i} AND s = {j}), '-Infinity'::DOUBLE) AS a{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3))},
         {", ".join(f"(SELECT lp FROM mom WHERE s = {j}) AS p{j}" for j in (1, 2, 3))}),
dens AS (
  SELECT t, {", ".join(f"(SELECT -0.5 * (ln(2 * pi() * v) + (x - m) ** 2 / v) FROM mom WHERE s = {j}) AS b{j}" for j in (1, 2, 3))}
  FROM seq),
fw(t, d1, d2, d3, k1, k2, k3) AS (
  SELECT t, p1 + b1, p2 + b2, p3 + b3, 0, 0, 0 FROM dens, par WHERE t = 1
  UNION ALL
  SELECT dens.t, {", ".join(f"greatest(d1 + a1{j}, d2 + a2{j}, d3 + a3{j}) + b{j}" for j in (1, 2, 3))},
         {", ".join(f"CASE greatest(d1 + a1{j}, d2 + a2{j}, d3 + a3{j}) WHEN d1 + a1{j} THEN 1 WHEN d2 + a2{j} THEN 2 ELSE 3 END" for j in (1, 2, 3))}
  FROM fw JOIN dens ON dens.t = fw.t + 1, par),
path(t, s) AS (
  SELECT t, CASE greatest(d1, d2, d3) WHEN d1 THEN 1 WHEN d2 THEN 2 ELSE 3 END FROM fw
  WHERE t = (SELECT max(t) FROM fw)
  UNION ALL
  SELECT fw.t - 1, CASE path.s WHEN 1 THEN k1 WHEN 2 THEN k2 ELSE k3 END
  FROM path JOIN fw ON fw.t = path.t WHERE fw.t > 1)""",
        """SELECT CVE_ID AS cve_id, x AS cvss, Year AS year,
list_extract(['Low Threat', 'Medium Threat', 'High Threat'], path.s) AS state FROM path JOIN seq USING (t)"""),
    "memm_path_observed": _rec(_OBSERVED + _GREEDY,
        """SELECT CVE_ID, list_extract(['Low Threat', 'Medium Threat', 'High Threat'], s) AS true_state,
list_extract(['Low Threat', 'Medium Threat', 'High Threat'], k) AS state FROM path JOIN seq USING (t)"""),
    "hmm_state_order": "WITH f AS (SELECT vec_id, " + _folded(15) + """ AS p FROM embeddings), e AS (
  SELECT vec_id, p, [q.i FOR q IN list_sort([{'m': p[k], 'i': k - 1} FOR k IN [1, 2, 3]])] AS o FROM f),
r AS (
  SELECT vec_id, o, p, [p[6 + 3 * o[1] + o[k] + 1] FOR k IN [1, 2, 3]] AS low_row FROM e),
b AS (SELECT *, list_position(low_row, list_max(low_row)) AS best FROM r)
SELECT vec_id, array_to_string(o, ' ') AS state_order, round(p[o[1] + 1], 6) AS low_mean,
  round(p[3 + o[3] + 1], 6) AS high_std_dev, round(p[6 + 3 * o[3] + o[1] + 1], 6) AS high_to_low,
  list_extract(['Low Threat', 'Medium Threat', 'High Threat'], best) AS predicted_next_state,
  round(list_max(low_row), 6) AS probability, round(p[o[best] + 1], 6) AS expected_next_cvss FROM b""",
    "feed_records": _with(RAW, "SELECT CVE_ID, Description, Year, CVSS_Score, CWE, 'Cross-Platform' AS OS FROM raw"),
    "stream_import": _with(TAB, f"""SELECT * EXCLUDE (doc_id) REPLACE ('Cross-Platform' AS OS,
CASE WHEN Year < '2023' THEN CVSS_Score ELSE 1.5 END AS CVSS_Score,
CASE WHEN Year < '2023' THEN True_Severity ELSE {_severity('1.5::DOUBLE')} END AS True_Severity,
CASE WHEN Year < '2023' THEN Severity_Confidence ELSE round(1 - least(0.4::DOUBLE, abs(1.5 - 5.0::DOUBLE) / 10), 2) END
  AS Severity_Confidence) FROM tab"""),
    "memm_outlook_observed": _rec(_OBSERVED + _GREEDY + """,
last AS (SELECT k FROM path WHERE t = (SELECT max(t) FROM path)),
lg AS (SELECT k, """ + ", ".join(f"m{j} / v * 8.5 + CASE k WHEN 1 THEN a1{j} WHEN 2 THEN a2{j} ELSE a3{j} END - m{j} ** 2 / (2 * v) AS l{j}"
                            for j in (1, 2, 3)) + """ FROM last, par)""",
        """SELECT list_extract(['Low Threat', 'Medium Threat', 'High Threat'], k) AS current_state,
list_extract(['Low Threat', 'Medium Threat', 'High Threat'],
  CASE greatest(l1, l2, l3) WHEN l1 THEN 1 WHEN l2 THEN 2 ELSE 3 END) AS predicted_next_state,
round(1 / (exp(l1 - greatest(l1, l2, l3)) + exp(l2 - greatest(l1, l2, l3)) + exp(l3 - greatest(l1, l2, l3))), 6) AS probability,
(SELECT round(avg(CAST(path.k = s AS INT)), 6) FROM path JOIN seq USING (t)) AS accuracy FROM lg"""),
    "stream_severity_counts": _count("True_Severity"),
    "csv_export": _with(TAB, """SELECT CVE_ID, Year, CVSS_Score, True_Severity AS Severity, Exploit_Type AS Exploit,
Affected_Component AS Component, Description FROM tab WHERE True_Severity = 'CRITICAL'"""),
}
ORACLES["stream_import_state"] = ORACLES["stream_import"]
ORACLES["growing_path"] = ORACLES["hmm_path_observed"]
ORACLES["kept_vocabulary"] = ORACLES["tfidf_vocabulary"]
ORACLES["kept_weights"] = ORACLES["tfidf_weights"]
ORACLES["kept_forecast"] = ORACLES["forecast_by_exploit"]
ORACLES["kept_mean_scores"] = _with(RAW, "SELECT CWE, count(*) AS n, round(avg(CVSS_Score), 6) AS mean FROM raw GROUP BY CWE")
ORACLES["prediction_drift"] = _with(_MODELLED + """,
logged AS (SELECT 'v1' AS model_version, Severity_Confidence AS x FROM tab UNION ALL SELECT 'v2', Severity_Confidence FROM mod),
sorted AS (SELECT model_version, count(*) AS n, list_sort(list(x)) AS a FROM logged GROUP BY ALL),
grid AS (SELECT model_version, n, [a[CAST(ceil(i * n / 256.0::DOUBLE) AS INT)] FOR i IN range(1, 257)] AS q FROM sorted),
base AS (SELECT q AS r, n AS n_reference FROM grid WHERE model_version = 'v1'),
bins AS (
  SELECT model_version, k, greatest(len(list_filter(q, lambda v: v > lo AND v <= hi)) / 256.0::DOUBLE, 0.5 / 256) AS c,
         greatest(len(list_filter(r, lambda v: v > lo AND v <= hi)) / 256.0::DOUBLE, 0.5 / 256) AS p
  FROM (SELECT model_version, q, r, k, CASE WHEN k = 0 THEN '-Infinity'::DOUBLE ELSE r[16 * k] END AS lo,
               CASE WHEN k = 15 THEN 'Infinity'::DOUBLE ELSE r[16 * k + 16] END AS hi
        FROM grid, base, range(16) b(k))),
psi AS (SELECT model_version, round(sum((p - c) * ln(p / c)), 6) AS psi FROM bins GROUP BY ALL)""",
    """SELECT model_version, n, 0::BIGINT AS n_null, n_reference, psi,
round(list_max([abs(len(list_filter(q, lambda v: v <= x)) - len(list_filter(r, lambda v: v <= x))) FOR x IN list_concat(q, r)])
  / 256.0::DOUBLE, 6) AS ks FROM grid JOIN psi USING (model_version), base""")
ORACLES["grouped_split"] = _rec("""cleaned AS (
  SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS c FROM documents),
ends AS (
  SELECT doc_id, 's' || substr(c, 1, 40) AS v FROM cleaned WHERE length(c) >= 40
  UNION ALL SELECT doc_id, 'e' || right(c, 40) FROM cleaned WHERE length(c) >= 40),
edges AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM ends a JOIN ends b ON a.v = b.v AND a.doc_id <> b.doc_id),
reach(a, b) AS (SELECT a, b FROM edges UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a),
grouped AS (
  SELECT doc_id, least(doc_id, coalesce(low, doc_id)) AS group_id
  FROM documents LEFT JOIN (SELECT a, min(b) AS low FROM reach GROUP BY a) ON a = doc_id)""",
    f"""SELECT doc_id, group_id, CASE WHEN bucket < 80 THEN 'train' WHEN bucket < 90 THEN 'validation' ELSE 'test' END AS side
FROM (SELECT doc_id, group_id, {_hash32('group_id')} % 100 AS bucket FROM grouped)""")
ORACLES["memm_gradient"] = """SELECT state, feature, 0.0::DOUBLE AS gradient
FROM (SELECT unnest(['Low Threat', 'Medium Threat', 'High Threat']) AS state),
     (SELECT unnest(['CVSS_Score', 'Prev_State_Low Threat', 'Prev_State_Medium Threat', 'Prev_State_High Threat',
                     'intercept']) AS feature)"""
ORACLES["forecast_guarded"] = _rec(TAB + """,
counts AS (
  SELECT Exploit_Type AS series, CAST(Year AS INT) AS t, count(*) AS n FROM tab
  WHERE Year >= '2025' OR Exploit_Type IN ('RCE', 'XSS', 'SQLi') GROUP BY ALL)""" + _arima(2),
    "SELECT series, t, linear_prediction, arima_prediction FROM fc")
ORACLES["category_by_length"] = ORACLES["category_inference"]
