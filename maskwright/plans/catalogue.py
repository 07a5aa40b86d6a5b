"""Registered queries of the detection engine and the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.functions import checks, tokens
from maskwright.functions import text as T
from maskwright.functions import values as V
from maskwright.operators import detect as D
from maskwright.operators import html as H
from maskwright.operators import image as I
from maskwright.operators import ner as N
from maskwright.operators import rewrite as R
from maskwright.plans import api
from maskwright.plans.letters import LETTERS
from maskwright.sources import inputs, store
from maskwright.sources.tables import spread, stored

#: A public key for the queries, whose results must be the same everywhere; real keys are arguments.
KEY = b"0123456789abcdef0123456789abcdef"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(LETTERS.replace("FROM customer", "FROM {customer}"), customer=spread(_table(spark, sf_dir, "customer").select("c_custkey")))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")


# ------------------------------------------------------------------ detectors

#: RE2 forms of the patterns. RE2 knows ASCII word boundaries only: MARKED has the patterns of detectors that are
#: held against texts where that makes a difference, with \\x04 for a boundary. There two \\x04 are put before and
#: behind each word beforehand, so that a match which ends at a boundary leaves one to the match which begins there,
#: and they are left out again before bytes are counted.
SQL_PATTERNS = {
    "email": (r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,24}\b", r"\0"),
    "phone": (r"(^|\D)((?:\+|00)\s?49[\s/-]*\d{2,5}[\s/-]*[\d\s/-]{3,15}\d|0\d{2,4}[\s/-]*[\d\s/-]{3,15}\d)(\D|$)", r"\2"),
    "iban": (r"\b[A-Z]{2}\d{2}(?:\s?[A-Z0-9]){10,30}\b", r"\0"),
    "card": (r"\b(?:\d[ -]?){13,19}\b", r"\0"),
    "tax_id": (r"\b\d{11}\b", r"\0"),
    "date": (r"\b(?:0?[1-9]|[12]\d|3[01])\.(?:0?[1-9]|1[0-2])\.(?:19|20)\d{2}\b", r"\0"),
    "vat": (r"\bDE\d{9}\b", r"\0"),
    "bic": (r"\b[A-Z]{4}DE[A-Z0-9]{2}(?:[A-Z0-9]{3})?\b", r"\0"),
    "url": (r"\b(?:https?://|www\.)[A-Za-z0-9][A-Za-z0-9.\-]*\.[A-Za-z]{2,}(?:/(?:[^\s<>()]*[^\s<>().,;:!?])?)?", r"\0"),
    "name": (r"\b[A-ZÄÖÜ][a-zäöüß](?:[A-ZÄÖÜa-zäöüß\-]*[a-zäöüß])?\b", r"\0"),
    "salutation": (r"\b((?:Herr|Hr\.|Hrn\.|Frau|Fr\.|Dr\.|Prof\.|Mag\.|Mr\.|Mrs\.|Ms\.)\s+(?:(?:Dr\.|Prof\.|Mag\.|Dipl\.-Ing\.)\s+)*)(\p{Lu}\p{Ll}(?:[\p{L}\-]*\p{Ll})?(?:\s+\p{Lu}\p{Ll}(?:[\p{L}\-]*\p{Ll})?)?)\b", r"\2"),
    "surname_first": (r"\b([A-ZÄÖÜ]\p{Ll}+)(,\s+)(\p{Lu}\p{Ll}+)\b", r"\1\3"),
    "city": (r"\b[A-ZÄÖÜ][a-zäöüß]{2,}(?:-[A-ZÄÖÜa-zäöüß][a-zäöüß]{1,})*\b", r"\0"),
    "organization": (r"\b([A-ZÄÖÜ][\p{L}\p{N}_.&\-]*(?:\s+(?:&|[\p{L}\p{N}_])[\p{L}\p{N}_.&\-]*){0,4}\s+(?:GmbH|gGmbH|AG|SE|KG|OHG|UG|e\.V\.|eG))([^\p{L}\p{N}_]|$)", r"\1"),
    "postal_code": (r"\b(\d{5})(\s+\p{Lu}\p{Ll}+\b)", r"\1"),
    "street": (r"\b[A-ZÄÖÜ][A-Za-zÄÖÜäöüß\-]+(?i:straße|str\.|weg|gasse|platz|allee|ring|chaussee|damm|ufer|markt)\s+\d+[a-zA-Z]?\b", r"\0"),
}
MARKED = {
    "email": (r"(?i)\x04[A-Z0-9._%+\-\x04]+@\x04*[A-Z0-9.\-\x04]+\.\x04+[A-Z]{2,24}\x04", r"\0"),
    "card": (r"\x04+(?:\d\x04*(?:[ -]\x04*)?){12,18}\d(?:\x04*[ -]\x04|\x04)", r"\0"),
    "name": (r"\x04+[A-ZÄÖÜ][a-zäöüß](?:[A-ZÄÖÜa-zäöüß\-\x04]*[a-zäöüß])?\x04", r"\0"),
    "city": (r"\x04+[A-ZÄÖÜ][a-zäöüß]{2,}(?:\x04+-\x04+[A-ZÄÖÜa-zäöüß][a-zäöüß]{1,})*\x04", r"\0"),
}
#: What each detector asks of a match (o) or of the text before it (b), in SQL.
_LUHN = "list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(reverse(d)[i] AS INT) ELSE (CAST(reverse(d)[i] AS INT) * 2) // 10 + (CAST(reverse(d)[i] AS INT) * 2) % 10 END)) % 10 = 0"
_DIGITS = "regexp_replace(o, '[^0-9]', '', 'g')"
_WORDS = lambda words: "lower(o) IN (" + ", ".join(f"'{w}'" for w in words) + ")"
_WORD_SETS = D.Gazetteer()
_REMAINDER = "list_reduce(list_prepend(10, list_transform(range(1, 11), lambda i: CAST({d}[i] AS INT))), lambda p, x: (CASE WHEN (p + x) % 10 = 0 THEN 10 ELSE (p + x) % 10 END * 2) % 11)"
TAX_SQL = (
    "CASE WHEN regexp_matches({d}, '^[1-9][0-9]{{10}}$') THEN len(list_filter(range(0, 10), lambda v: len(list_filter(range(1, 11), lambda i: CAST({d}[i] AS INT) = v)) IN (2, 3))) = 1"
    " AND (11 - " + _REMAINDER + ") % 10 = CAST({d}[11] AS INT) ELSE false END"
)
PREDICATES = {
    "phone": f"length({_DIGITS}) BETWEEN 6 AND 16 AND NOT (regexp_matches(b, '0[xX][0-9a-fA-F]*$') OR regexp_matches(b, '[a-fA-F]$') OR regexp_matches(a, '^[a-fA-F]'))",
    "iban": "regexp_matches(regexp_replace(o, '\\s', '', 'g'), '^DE[0-9]{20}$') AND CAST(substr(regexp_replace(o, '\\s', '', 'g'), 5) || '1314' || substr(o, 3, 2) AS HUGEINT) % 97 = 1",
    "card": f"length({_DIGITS}) BETWEEN 13 AND 19 AND (SELECT {_LUHN} FROM (SELECT {_DIGITS} AS d))",
    "tax_id": TAX_SQL.format(d="o") + " AND (" + " OR ".join(f"contains(lower(right(b, {V.CUE_WINDOW})), '{cue}')" for cue in V.TAX_ID_CUES) + ")",
    "name": _WORDS(_WORD_SETS.names),
    "city": _WORDS(_WORD_SETS.cities),
    "surname_first": "lower(coalesce(CASE WHEN k % 4 = 2 THEN lead(o) OVER (PARTITION BY id ORDER BY k) ELSE o END, '')) IN (" + ", ".join(f"'{w}'" for w in _WORD_SETS.first_names) + ")",
}


def spans_sql(name: str, source: str) -> str:
    """SELECT id, span_start, span_end, original of one detector over a source with id and text."""
    pattern, group = MARKED.get(name) or SQL_PATTERNS[name]
    text = r"regexp_replace(replace(text, chr(4), chr(3)), '[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]+', repeat(chr(4), 2) || '\0' || repeat(chr(4), 2), 'g')" if name in MARKED else "text"
    mark = {r"\0": "chr(1) || '\\0' || chr(2)", r"\1": "chr(1) || '\\1' || chr(2) || '\\2'", r"\2": "'\\1' || chr(1) || '\\2' || chr(2)" + (" || '\\3'" if name == "phone" else ""), r"\1\3": "chr(1) || '\\1' || chr(2) || '\\2' || chr(1) || '\\3' || chr(2)"}[group]
    return f"""SELECT id, span_start, span_end, o AS original FROM (
  SELECT id, k, o, span_start, span_start + strlen(o) AS span_end, b, a, {PREDICATES.get(name, 'true')} AS ok FROM (
    SELECT id, k, o, coalesce(sum(strlen(o)) OVER w, 0)::INT AS span_start, coalesce(string_agg(o, '') OVER w, '') AS b, lead(o) OVER (PARTITION BY id ORDER BY k) AS a FROM (
      SELECT id, replace(unnest(p), chr(4), '') AS o, generate_subscripts(p, 1) AS k FROM (SELECT id, string_split_regex(regexp_replace({text}, '{pattern.replace("'", "''")}', {mark}, 'g'), '[\\x01\\x02]') AS p FROM {source}))
    WINDOW w AS (PARTITION BY id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  WHERE k % 2 = 0) WHERE ok"""


def _detect_one(name: str, source: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = {"letters": lambda: letters(spark, sf_dir).withColumnRenamed("letter_id", "id"), "documents": lambda: _documents(spark, sf_dir).withColumnRenamed("doc_id", "id"), "pages": lambda: _table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("text"))}[source]()
        detector = next(d for d in D.detectors() if d.name == name)
        found = detector.findings(F.coalesce("text", F.lit("")), 0)
        if name == "surname_first":
            found = checks.let(found, lambda x: D._pairs(x, D.Gazetteer()))
        return rows.select("id", F.explode_outer(found).alias("f")).filter("f is not null").select("id", F.col("f.start").alias("span_start"), F.col("f.end").alias("span_end"), "f.original")

    return run


_SOURCES = {"letters": f"(SELECT letter_id AS id, text FROM ({LETTERS}))", "documents": "(SELECT doc_id AS id, coalesce(text, '') AS text FROM documents)", "pages": "(SELECT page_id AS id, html AS text FROM pages)"}
for _name in SQL_PATTERNS:
    _query(f"detect_{_name}", spans_sql(_name, _SOURCES["letters"]))(_detect_one(_name, "letters"))
for _name, _source in (("email", "documents"), ("card", "documents"), ("name", "documents"), ("city", "documents"), ("url", "pages")):
    _query(f"detect_{_name}_{_source}", spans_sql(_name, _SOURCES[_source]))(_detect_one(_name, _source))


def findings_sql(source: str, persons: list[str] | None = None) -> str:
    """All detectors over a source: disjoint findings, by a recursive walk in the order of start, length and detector."""
    ranked = [(d.name, d.entity_type, rank) for rank, d in enumerate(D.detectors())]
    parts = "\n UNION ALL ".join(f"SELECT id, span_start AS s, span_end AS e, original, '{kind}' AS entity_type, {rank} AS ord FROM ({spans_sql(name, 'src')})" for name, kind, rank in ranked)
    return f"""WITH RECURSIVE src AS MATERIALIZED (SELECT * FROM {source}),
raw AS (SELECT * FROM ({parts})),
more AS (SELECT raw.*, CASE WHEN entity_type = 'person' THEN regexp_extract(decode(encode(src.text)[raw.e + 1 : ]), '^\\s+\\p{{Lu}}\\p{{Ll}}+') ELSE '' END AS tail FROM raw JOIN src USING (id)),
f AS MATERIALIZED (SELECT id, s, e + strlen(tail) AS e, original || tail AS original, entity_type, row_number() OVER (PARTITION BY id ORDER BY s, -(e + strlen(tail)), ord) AS n FROM more),
walk(id, n, last, keep) AS (
  SELECT id, n, e, true FROM f WHERE n = 1
  UNION ALL
  SELECT f.id, f.n, CASE WHEN f.s >= walk.last THEN f.e ELSE walk.last END, f.s >= walk.last FROM walk JOIN f ON f.id = walk.id AND f.n = walk.n + 1),
kept AS (SELECT f.* FROM f JOIN walk USING (id, n) WHERE keep)
"""


@_query("entity_counts", findings_sql(_SOURCES["documents"]) + "SELECT lang, entity_type, count(*) AS findings, count(DISTINCT doc_id) AS documents FROM kept JOIN documents ON doc_id = id GROUP BY ALL")
def _entity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _documents(spark, sf_dir).select("lang", "doc_id", F.explode_outer(D.detect_column("text")).alias("f")).filter("f is not null")
    return rows.groupBy("lang", F.col("f.entity_type").alias("entity_type")).agg(F.count("*").alias("findings"), F.count_distinct("doc_id").alias("documents"))


@_query("detect_letters", findings_sql(_SOURCES["letters"]) + "SELECT id, s AS span_start, e AS span_end, entity_type, original FROM kept")
def _detect_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = letters(spark, sf_dir).select(F.col("letter_id").alias("id"), F.explode_outer(D.detect_column("text")).alias("f")).filter("f is not null")
    return rows.select("id", F.col("f.start").alias("span_start"), F.col("f.end").alias("span_end"), "f.entity_type", "f.original")


# ------------------------------------------------------------------ checks

@_query("luhn", f"SELECT o_orderkey, {_LUHN} AS valid FROM (SELECT o_orderkey, '' || (4000000000000000 + o_orderkey * 7919) AS d FROM orders)")
def _luhn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").select("o_orderkey", checks.luhn((F.lit(4000000000000000) + F.col("o_orderkey") * 7919).cast("string")).alias("valid"))


@_query("mod97", "SELECT o_orderkey, CAST(lpad('' || o_orderkey, 18, '3') || '1314' || lpad('' || (o_orderkey % 97), 2, '0') AS HUGEINT) % 97 AS remainder FROM orders")
def _mod97(spark: SparkSession, sf_dir: str) -> DataFrame:
    account = F.concat(F.lit("DE"), F.lpad((F.col("o_orderkey") % 97).cast("string"), 2, "0"), F.lpad(F.col("o_orderkey").cast("string"), 18, "3"))
    return _table(spark, sf_dir, "orders").select("o_orderkey", checks.mod97(account).cast("long").alias("remainder"))


@_query("tax_id_check", f"SELECT o_orderkey, {TAX_SQL.format(d='d')} AS valid FROM (SELECT o_orderkey, '' || (86095742000 + o_orderkey) AS d FROM orders)")
def _tax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").select("o_orderkey", checks.tax_id((F.lit(86095742000) + F.col("o_orderkey")).cast("string")).alias("valid"))


# ------------------------------------------------------------------ spans, tokens, labels

_INTERVALS = "SELECT l_orderkey AS id, l_linenumber * 7 % 20 AS s, l_linenumber * 7 % 20 + 1 + l_partkey % 9 AS e, l_suppkey % 16 AS ord FROM lineitem"


@_query("dedupe_spans", f"""WITH RECURSIVE i AS (SELECT DISTINCT * FROM ({_INTERVALS})), f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s, -e, ord) AS n FROM i),
walk(id, n, last, keep) AS (SELECT id, n, e, true FROM f WHERE n = 1 UNION ALL
  SELECT f.id, f.n, CASE WHEN f.s >= walk.last THEN f.e ELSE walk.last END, f.s >= walk.last FROM walk JOIN f ON f.id = walk.id AND f.n = walk.n + 1)
SELECT f.id, s AS span_start, e AS span_end, ord FROM f JOIN walk USING (id, n) WHERE keep""")
def _dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(_INTERVALS.replace("FROM lineitem", "FROM {lineitem}"), lineitem=_table(spark, sf_dir, "lineitem")).distinct()
    one = F.struct(F.lit("x").alias("entity_type"), F.lit("").alias("original"), F.col("s").cast("int").alias("start"), F.col("e").cast("int").alias("end"), F.lit(1.0).alias("confidence"), F.col("ord").cast("int").alias("ord"))
    found = rows.groupBy("id").agg(F.collect_list(one).alias("all")).select("id", F.explode(D.resolved(F.col("all"))).alias("f"))
    return found.select("id", F.col("f.start").cast("long").alias("span_start"), F.col("f.end").cast("long").alias("span_end"), F.col("f.ord").cast("long").alias("ord"))


def _hmac_sql(key: bytes, message: str) -> str:
    inner, outer = (p.hex() for p in tokens.pads(key))
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({message}))))"


def _token_sql(letter: str, message: str, key: bytes = KEY) -> str:
    digit = lambda k: f"substr('{tokens.BASE32}', ((('0x' || substr(h, 1, 8))::BIGINT >> {27 - 5 * k}) & 31)::INT + 1, 1)"
    return f"(SELECT '«{letter}_' || {' || '.join(digit(k) for k in range(6))} || '»' FROM (SELECT {_hmac_sql(key, message)} AS h))"


@_query("make_token", f"SELECT c_custkey, {_token_sql('P', 'c_name')} AS token FROM customer")
def _make_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner, outer = (F.lit(bytearray(p)) for p in tokens.pads(KEY))
    return _table(spark, sf_dir, "customer").select("c_custkey", tokens.make_token(F.lit("person"), F.col("c_name"), inner, outer).alias("token"))


def _case_token_sql() -> str:
    """Tokens under the secret of each row's case: the pads are made byte by byte from the key's hex."""
    byte = "('0x' || substr(h, i * 2 - 1, 2))::BIGINT"
    pad = lambda mask: f"unhex(array_to_string(list_transform(range(1, 65), lambda i: printf('%02X', xor(CASE WHEN i <= 32 THEN {byte} ELSE 0 END, {mask}))), ''))"
    digit = lambda k: f"substr('{tokens.BASE32}', ((('0x' || substr(t, 1, 8))::BIGINT >> {27 - 5 * k}) & 31)::INT + 1, 1)"
    keyed = _hmac_sql(KEY, "'case:' || c_custkey")
    return f"SELECT c_custkey, '«O_' || {' || '.join(digit(k) for k in range(6))} || '»' AS token FROM (SELECT c_custkey, sha256({pad(0x5C)} || unhex(sha256({pad(0x36)} || encode(c_mktsegment)))) AS t FROM (SELECT c_custkey, c_mktsegment, {keyed} AS h FROM customer))"


@_query("make_case_token", _case_token_sql())
def _make_case_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tokens.with_case_pads(_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.col("c_custkey").cast("string").alias("case_id")), KEY)
    return rows.select("c_custkey", tokens.make_token(F.lit("organization"), F.col("c_mktsegment"), F.col("inner_pad"), F.col("outer_pad")).alias("token"))


@_query("normalise", r"SELECT c_custkey, trim(regexp_replace(replace(replace(replace('  ' || c_name || chr(160) || chr(9) || ' x' || chr(8203) || 'y' || chr(65279), chr(160), ' '), chr(8203), ''), chr(65279), ''), '\s+', ' ', 'g')) AS plain FROM customer")
def _normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("  "), F.col("c_name"), F.lit(" \t x​y﻿"))
    return _table(spark, sf_dir, "customer").select("c_custkey", tokens.normalised(raw).alias("plain"))


@_query("letter_index", """SELECT c_custkey, CASE WHEN n <= 26 THEN chr(64 + n) WHEN n <= 702 THEN chr(64 + (n - 1) // 26) || chr(65 + (n - 1) % 26)
ELSE chr(64 + (n - 703) // 676 + 1) || chr(65 + (n - 703) // 26 % 26) || chr(65 + (n - 703) % 26) END AS letters FROM (SELECT c_custkey, (c_custkey + 1)::INT AS n FROM customer)""")
def _letter_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").select("c_custkey", tokens.letters(F.col("c_custkey") + 1).alias("letters"))


_TYPE_WORD = "CASE entity_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.TYPE_WORDS.items()) + f" ELSE '{V.OTHER_WORD}' END"


@_query("strict_labels", findings_sql(_SOURCES["letters"]) + rf""", p AS (SELECT *, trim(regexp_replace(original, '\s+', ' ', 'g')) AS norm FROM kept),
q AS (SELECT *, min(s) OVER (PARTITION BY id, entity_type, norm) AS first FROM p)
SELECT id, s AS span_start, '«' || {_TYPE_WORD} || ' ' || chr(64 + (dense_rank() OVER (PARTITION BY id, entity_type ORDER BY first))::INT) || '»' AS label FROM q""")
def _strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = letters(spark, sf_dir).select(F.col("letter_id").alias("id"), F.explode_outer(R.placeholders(D.detect_column("text"))).alias("f")).filter("f is not null")
    return rows.select("id", F.col("f.start").alias("span_start"), F.col("f.token").alias("label"))


@_query("anonymise_letters", findings_sql(_SOURCES["letters"]) + rf""", p AS (SELECT *, trim(regexp_replace(original, '\s+', ' ', 'g')) AS norm FROM kept),
q AS (SELECT *, min(s) OVER (PARTITION BY id, entity_type, norm) AS first FROM p),
l AS (SELECT id, s, e, '«' || {_TYPE_WORD} || ' ' || chr(64 + (dense_rank() OVER (PARTITION BY id, entity_type ORDER BY first))::INT) || '»' AS label, coalesce(lag(e) OVER (PARTITION BY id ORDER BY s), 0) AS before FROM q),
t AS (SELECT id, string_agg(decode(encode(text)[before + 1 : s]) || label, '' ORDER BY s) AS body, max(e) AS last FROM l JOIN src USING (id) GROUP BY id)
SELECT id, body || decode(encode(text)[last + 1 : ]) || '{V.STRICT_HINT}' AS redacted_text FROM t JOIN src USING (id)""".replace(V.STRICT_HINT, "' || chr(10) || chr(10) || '" + V.STRICT_HINT.lstrip().replace("\n", "' || chr(10) || '")))
def _anonymise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.anonymise(letters(spark, sf_dir).withColumnRenamed("letter_id", "id")).select("id", "redacted_text")


def _pseudonymise_sql() -> str:
    """Findings, a token for each under the secret of its letter, and the text with the tokens in place."""
    byte = "('0x' || substr(h, i * 2 - 1, 2))::BIGINT"
    pad = lambda mask: f"unhex(array_to_string(list_transform(range(1, 65), lambda i: printf('%02X', xor(CASE WHEN i <= 32 THEN {byte} ELSE 0 END, {mask}))), ''))"
    digit = lambda k: f"substr('{tokens.BASE32}', ((('0x' || substr(t, 1, 8))::BIGINT >> {27 - 5 * k}) & 31)::INT + 1, 1)"
    letter = "CASE entity_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.TYPE_LETTERS.items()) + " END"
    hint = "' || chr(10) || chr(10) || '" + V.HINT.lstrip().replace("\n", "' || chr(10) || '")
    return findings_sql(_SOURCES["letters"]) + rf""", secret AS (SELECT id, inner_pad, outer_pad FROM (SELECT id, {pad(0x36)} AS inner_pad, {pad(0x5C)} AS outer_pad FROM (SELECT id, {_hmac_sql(KEY, "'case:' || id")} AS h FROM src))),
k AS (SELECT kept.*, sha256(outer_pad || unhex(sha256(inner_pad || encode(trim(regexp_replace(original, '\s+', ' ', 'g')))))) AS t FROM kept JOIN secret USING (id)),
l AS (SELECT id, s, e, '«' || {letter} || '_' || {' || '.join(digit(i) for i in range(6))} || '»' AS label, coalesce(lag(e) OVER (PARTITION BY id ORDER BY s), 0) AS before FROM k),
t AS (SELECT id, string_agg(decode(encode(text)[before + 1 : s]) || label, '' ORDER BY s) AS body, max(e) AS last, count(*)::INT AS findings FROM l JOIN src USING (id) GROUP BY id)
SELECT id AS letter_id, body || decode(encode(text)[last + 1 : ]) || '{hint}' AS redacted_text, findings FROM t JOIN src USING (id)"""


@_query("pseudonymise_letters", _pseudonymise_sql())
def _pseudonymise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.pseudonymise(letters(spark, sf_dir).withColumn("case_id", F.col("letter_id").cast("string")), KEY, case="case_id").select("letter_id", "redacted_text", F.size("findings").alias("findings"))


def _with_mappings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = letters(spark, sf_dir).withColumn("case_id", F.col("letter_id").cast("string"))
    rows = stored(api.pseudonymise(rows, KEY, case="case_id", hint=False))
    return rows, api.mappings_of(rows, "case_id", F.to_timestamp(F.lit("2024-01-01 00:00:00"))).dropDuplicates(["case_id", "token"])


@_query("restore_case", f"SELECT letter_id, text FROM ({LETTERS})")
def _restore_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, mappings = _with_mappings(spark, sf_dir)
    return store.restore_case(rows.select("letter_id", "case_id", F.col("redacted_text").alias("text")), mappings).select("letter_id", "text")


@_query("restore_all", f"SELECT letter_id, text FROM ({LETTERS})")
def _restore_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, mappings = _with_mappings(spark, sf_dir)
    return store.restore_all(rows.select("letter_id", F.col("redacted_text").alias("text")), mappings, "letter_id").select("letter_id", "text")


@_query("extract_tokens", f"SELECT c_custkey, array_to_string(list_distinct_first, ',') AS tokens FROM (SELECT c_custkey, [{_token_sql('P', 'c_name')}, {_token_sql('O', 'c_mktsegment')}] AS list_distinct_first FROM customer)")
def _extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner, outer = (F.lit(bytearray(p)) for p in tokens.pads(KEY))
    person, firm = (tokens.make_token(F.lit(t), F.col(c), inner, outer) for t, c in (("person", "c_name"), ("organization", "c_mktsegment")))
    text = F.concat(F.lit("a "), person, F.lit(" «P_abcdefg» b "), firm, person)
    return _table(spark, sf_dir, "customer").select("c_custkey", F.array_join(T.extract_tokens(text), ",").alias("tokens"))


_KNOWN_TOKEN = "«E_abc234»"
_TURNS = f"(SELECT conv_id || '/' || turn AS id, CASE WHEN turn % 3 = 0 THEN '{_KNOWN_TOKEN} ' || text ELSE coalesce(text, '') END AS text FROM conversations)"


def _smart_sql() -> str:
    """Reverse where a known token stands before the text, else forward where any detector finds something."""
    found = "\n UNION ALL ".join(f"SELECT id FROM ({spans_sql(d.name, 'src')})" for d in D.detectors())
    return f"""WITH src AS MATERIALIZED (SELECT * FROM {_TURNS}), found AS MATERIALIZED (SELECT DISTINCT id FROM ({found}))
SELECT conv_id, turn, CASE WHEN turn % 3 = 0 AND text IS NOT NULL THEN 'reverse' WHEN conv_id || '/' || turn IN (SELECT id FROM found) THEN 'forward' ELSE 'pass' END AS action FROM conversations"""


@_query("smart_action", _smart_sql())
def _smart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _smart_actions(spark, _table(spark, sf_dir, "conversations"))


def _smart_actions(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """The action on each turn, when every third one has a known token before it."""
    token = _KNOWN_TOKEN
    rows = turns.withColumn("key", F.concat_ws("/", "conv_id", "turn"))
    rows = rows.withColumn("text", F.when(F.col("turn") % 3 == 0, F.concat(F.lit(token + " "), F.col("text"))).otherwise(F.col("text")))
    mappings = spark.createDataFrame([("c", token, "someone@example.com")], "case_id string, token string, original string").withColumn("first_seen", F.to_timestamp(F.lit("2024-01-01 00:00:00")))
    return api.smart_transform(rows, "key", mappings, KEY).select("conv_id", "turn", "action")


@_query("classify_input", "SELECT doc_id, CASE WHEN text IS NULL OR text = '' THEN 'empty' WHEN strlen(text) > 10485760 THEN 'too_large' ELSE 'proceed' END AS class FROM documents")
def _classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", inputs.classified(F.col("text")).alias("class"))


# ------------------------------------------------------------------ store

_LOG = "SELECT 'c' || user_id AS case_id, 't' || event_id % 50 AS token, event_type AS original, CAST(ts AS TIMESTAMP) AS first_seen FROM events"


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_LOG.replace("FROM events", "FROM {events}"), events=_table(spark, sf_dir, "events"))


_MICROS = "epoch_us(first_seen) AS first_seen_us"
_SEEN = F.unix_micros


@_query("record_idempotent", f"WITH l AS ({_LOG}), f AS (SELECT *, row_number() OVER (PARTITION BY case_id, token ORDER BY first_seen, original) AS n FROM l) SELECT case_id, token, original, {_MICROS} FROM f WHERE n = 1 AND case_id <> 'c1'")
def _record(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir)
    known = log.filter("case_id = 'c1'")
    return store.record(known, log).select("case_id", "token", "original", _SEEN("first_seen").alias("first_seen_us"))


@_query("purge_ttl", f"WITH l AS ({_LOG}) SELECT case_id, token, original, {_MICROS} FROM l WHERE first_seen >= TIMESTAMP '2024-01-08 00:00:00' - INTERVAL 1440 MINUTES")
def _purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.purged(_log(spark, sf_dir), F.to_timestamp(F.lit("2024-01-08 00:00:00")), 1440).select("case_id", "token", "original", _SEEN("first_seen").alias("first_seen_us"))


@_query("mapping_count", f"WITH l AS ({_LOG}) SELECT case_id, count(*) AS mappings FROM l WHERE case_id <> 'c2' GROUP BY 1")
def _count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.cleared(_log(spark, sf_dir), "c2").groupBy("case_id").agg(F.count("*").alias("mappings"))


@_query("token_collisions", f"WITH l AS ({_LOG}) SELECT case_id, token, count(DISTINCT original) AS originals FROM l GROUP BY 1, 2 HAVING count(DISTINCT original) > 1")
def _collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.collisions(_log(spark, sf_dir))


@_query("stash_title", r"SELECT doc_id, left(trim(regexp_replace(text, '\s+', ' ', 'g')), 60) AS title, length(text)::INT AS char_len FROM documents")
def _title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.title_and_length(_documents(spark, sf_dir), "text").select("doc_id", "title", "char_len")


@_query("stash_list", """SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS created_at, 'strict' AS mode, lpad('' || o_orderkey, 9, '0') AS title,
'{"person":' || (o_custkey % 3 + 1) || '}' AS entity_counts, 9 AS char_len, 'plain' AS content_kind FROM orders""")
def _stash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("timestamp").alias("created_at"), F.lit("strict").alias("mode"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0").alias("redacted_text"), F.create_map(F.lit("person"), (F.col("o_custkey") % 3 + 1).cast("int")).alias("entity_counts"), F.lit("plain").alias("content_kind"))
    return store.archive_list(store.archived(spark.createDataFrame([], store.ARCHIVE), rows))


@_query("encrypted_roundtrip", "SELECT c_custkey, c_name AS original FROM customer")
def _encrypted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("original"))
    return store.decrypted(store.encrypted(rows, F.lit(bytearray(KEY))), F.lit(bytearray(KEY)))


# ------------------------------------------------------------------ HTML, images, recognition

@_query("filter_style", "SELECT c_custkey, 'color: red' || CASE WHEN c_custkey % 2 = 0 THEN '; width: ' || c_custkey || 'px' ELSE '' END AS style FROM customer")
def _style(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit(" COLOR : red; position:absolute; background-color: URL(x) ;; nothing;"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("width:"), F.col("c_custkey").cast("string"), F.lit("px"))).otherwise(F.lit("")))
    return _table(spark, sf_dir, "customer").select("c_custkey", T.filter_style(raw).alias("style"))


@_query("html_escape", "SELECT page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM pages")
def _escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", T.escape_html(F.col("html")).alias("escaped"))


@_query("html_plaintext")
def _plaintext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.with_text(_table(spark, sf_dir, "pages")).select("page_id", "sanitised", "plaintext")


@_query("html_redact")
def _redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.redact_pages(_table(spark, sf_dir, "pages")).select("page_id", "annotated_html", "redacted_html", F.size("findings").alias("findings"))


_WORDS_SQL = "SELECT p_partkey, p_size % 5 + 1 AS lines, p_name FROM part"


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised words: those of the part's name, once a line, on a grid."""
    names = F.split("p_name", " ")
    word = lambda t, i, line: F.struct(t.alias("text"), (i * 0.25).alias("x"), (line * 0.125).alias("y"), F.lit(0.125).alias("w"), F.lit(0.0625).alias("h"), line.cast("int").alias("line"))
    words = F.flatten(F.transform(F.sequence(F.lit(0), F.col("p_size") % 5), lambda line: F.transform(names, lambda t, i: word(t, i, line))))
    return _table(spark, sf_dir, "part").select("p_partkey", words.alias("words"))


@_query("ocr_assemble", "SELECT p_partkey, array_to_string(list_transform(range(0, p_size % 5 + 1), lambda i: p_name), chr(10)) AS text, (len(string_split(p_name, ' ')) * (p_size % 5 + 1))::INT AS words FROM part")
def _assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _words(spark, sf_dir).select("p_partkey", I.assembled(F.col("words")).alias("a"))
    return rows.select("p_partkey", "a.text", F.size("a.slices").alias("words"))


@_query("boxes", """SELECT p_partkey, 0 AS finding, line::INT AS line, 0.0::DOUBLE AS x, line * 0.125::DOUBLE AS y, (len(string_split(p_name, ' ')) - 1) * 0.25 + 0.125::DOUBLE AS w, 0.0625::DOUBLE AS h
FROM (SELECT *, unnest(range(0, p_size % 5 + 1)) AS line FROM part)""")
def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One finding over the whole text gives a box a line."""
    rows = _words(spark, sf_dir).withColumn("a", I.assembled(F.col("words"))).withColumn("slices", F.col("a.slices"))
    whole = F.struct(F.lit(0).alias("start"), F.octet_length("a.text").alias("end"), F.lit("person").alias("entity_type"), F.lit("«Person A»").alias("token"))
    found = I.boxes(rows.withColumn("findings", F.array(whole)), "p_partkey")
    return found.select("p_partkey", "finding", "line", "x", "y", "w", "h")


@_query("box_pixels", "SELECT p_partkey, greatest(floor(p_size / 64 * 800) - 3, 0)::INT AS lft, least(ceil((p_size / 64 + 0.125) * 800) + 3, 800)::INT AS rgt FROM part")
def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("p_size") / 64
    box = I.pixels(x, F.lit(0.0), F.lit(0.125), F.lit(0.5), F.lit(800), F.lit(600))
    return _table(spark, sf_dir, "part").select("p_partkey", box.left.alias("lft"), box.right.alias("rgt"))


@_query("softmax_conf", "SELECT vec_id, list_position(l, list_max(l)) - 1 AS label, round(1 / list_sum(list_transform(l, lambda x: exp((x - list_max(l))::DOUBLE))), 5) AS probability FROM (SELECT vec_id, embedding[1:9] AS l FROM embeddings)")
def _softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", N.softmax_column(F.slice("embedding", 1, 9)).alias("s"))
    return rows.select("vec_id", "s.label", F.round("s.probability", 5).alias("probability"))


@_query("bio_spans", """WITH t AS (SELECT event_id // 20 AS doc, event_id % 20 AS tok, (event_id * 7 + user_id) % 9 AS label, 0.6 + (event_id % 40) / 100 AS p FROM events),
k AS (SELECT *, CASE WHEN label = 0 THEN NULL ELSE (label - 1) // 2 END AS kind, label % 2 = 1 AS begins FROM t),
o AS (SELECT *, kind IS NOT NULL AND (begins OR kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY doc ORDER BY tok)) AS opens FROM k),
s AS (SELECT *, sum(opens::INT) OVER (PARTITION BY doc ORDER BY tok) AS span FROM o)
SELECT doc, CASE kind WHEN 0 THEN 'date' WHEN 1 THEN 'person' WHEN 2 THEN 'organization' ELSE 'location' END AS entity_type, (min(tok) * 5)::INT AS span_start, (max(tok) * 5 + 4)::INT AS span_end, round(exp(avg(ln(p))), 6) AS confidence
FROM s WHERE kind IS NOT NULL GROUP BY doc, span, kind HAVING exp(avg(ln(p))) >= 0.70""")
def _bio(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    tok = (F.col("event_id") % 20).cast("int")
    rows = events.select(F.floor(F.col("event_id") / 20).alias("doc"), tok.alias("tok"), (tok * 5).alias("start"), (tok * 5 + 4).alias("end"), ((F.col("event_id") * 7 + F.col("user_id")) % 9).cast("int").alias("label"), (F.lit(0.6) + (F.col("event_id") % 40) / 100).alias("probability"))
    return N.spans_of_tokens(rows, "doc").select("doc", "entity_type", F.col("start").alias("span_start"), F.col("end").alias("span_end"), F.round("confidence", 6).alias("confidence"))


def _grey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small white image for each part, with a city and a word of the part's name as recognised words."""
    import numpy as np

    png = I.encode(np.full((32, 64, 1), 255, np.uint8))
    word = lambda text, x, line: F.struct(text.alias("text"), F.lit(x).alias("x"), F.lit(line / 2).alias("y"), F.lit(0.25).alias("w"), F.lit(0.25).alias("h"), F.lit(line).alias("line"))
    city = F.when(F.col("p_partkey") % 2 == 0, "Bremen").otherwise("bremen")
    return _table(spark, sf_dir, "part").select("p_partkey", F.lit(bytearray(png)).alias("image"), F.array(word(F.lit("aus"), 0.0, 0), word(city, 0.5, 0), word(F.lit("und"), 0.0, 1)).alias("words"))


@_query("image_redact", """SELECT p_partkey, 'aus ' || CASE WHEN p_partkey % 2 = 0 THEN 'Bremen' ELSE 'bremen' END || chr(10) || 'und' AS text, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END::INT AS boxes,
CASE WHEN p_partkey % 2 = 0 THEN '0.5,0.0,0.25,0.25' ELSE '' END AS place, CASE WHEN p_partkey % 2 = 0 THEN 22 * 11 ELSE 0 END::INT AS black FROM part""")
def _image_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole image flow; black: the pixels that are painted (the box, 16 by 8, with its padding, within the image)."""
    import pandas as pd

    def dark(images: pd.Series) -> pd.Series:
        return pd.Series([int((I.decode(bytes(x)) == 0).sum()) for x in images], dtype="int32")

    dark.__annotations__ = {"images": pd.Series, "return": pd.Series}
    rows = api.redact_images(_grey(spark, sf_dir), "p_partkey")
    place = F.array_join(F.transform("boxes", lambda b: F.concat_ws(",", b.x.cast("string"), b.y.cast("string"), b.w.cast("string"), b.h.cast("string"))), ";")
    return rows.select("p_partkey", "text", F.size("boxes").alias("boxes"), place.alias("place"), F.pandas_udf(dark, "int")("redacted_image").alias("black"))


# ------------------------------------------------------------------ streams

def _changes(events: Column | DataFrame) -> DataFrame:
    return events.select((F.col("event_id") % 400).alias("seq"), "ts", F.col("event_type").alias("app"), F.col("props").alias("text"), F.when(F.col("user_id") == 1, "engine").otherwise("user").alias("origin"))


@_query("stream_dedupe", "SELECT event_id % 400 AS seq, count(*) > 0 AS seen FROM events WHERE user_id <> 1 AND props <> '' GROUP BY 1")
def _stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch, not a stream: each key once over all events, of 400 keys. A stream drops repeats only within its
    watermark of 10 minutes, so of these keys it would emit later repeats again."""
    from maskwright.streaming import changes as C

    rows = C.accepted(_changes(_table(spark, sf_dir, "events")), [])
    return rows.select("seq", F.lit(True).alias("seen"))


@_query("change_filter", "WITH e AS (SELECT event_id, user_id, event_type AS text, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS last, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) SELECT event_id, user_id, text FROM e WHERE n = 1 OR text IS DISTINCT FROM last")
def _change_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.changes(_table(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_type").alias("text")), "event_id", "user_id")


@_query("stream_retention", f"WITH l AS ({_LOG}) SELECT epoch_us(time_bucket(INTERVAL 60 MINUTES, first_seen)) AS window_us, count(*) AS mappings FROM l GROUP BY 1")
def _retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch, not a stream."""
    from maskwright.streaming import changes as C

    return C.retained(_log(spark, sf_dir), 60).select(_SEEN("window.start").alias("window_us"), F.col("count").alias("mappings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
