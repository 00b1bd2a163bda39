"""Secret scans with multipart credential linking, in DataFrame functions only.

Base findings, leftmost and non-overlapping for each kind: ``assign`` (a name such as password or api_key, a sign, a
value of six or more characters), ``access`` (AKIA and capitals or digits, 20 or more), ``hex`` (24 or more lower-case
hex digits). Positions are code points: the texts between the matches of a pattern and the matches
themselves, both from the same left-to-right scan, add up to them.

Linking: access identifiers, secrets and endpoints are parts of one credential. Weak candidates are
- ``secret``: a run of 40 characters of base64 that mixes capitals, small letters and digits and belongs to no base finding,
- ``endpoint``: an http(s) or database URL.
Each is reported only when a complementary part stands in the same scope: a secret with an access identifier or an
endpoint that carries a host of its own, an endpoint with an access identifier or a secret or assign finding. A scope is
``SCOPE`` characters between the parts' starts. This is an interval join: parts are put into bins of ``SCOPE`` characters,
a candidate looks into its own and the two neighbouring bins, and a semi-join on (row, bin, role) with the distance as
condition tells whether a part is near, so no pair is ever emitted.

Scale: one pass over the texts, which are not shuffled; only rows with candidates are exploded, as positions. Row and bin together
are the join key, so neither a hot document nor a hot source gathers in one task.

Cases: null text counts as empty; very long texts, and texts of very many findings, are scanned whole; repeated rows are scanned each; a null doc_id is reported as null; other columns are
not looked at; an empty table gives an empty table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, read_table

SCOPE = 400

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
SECRET = r"[A-Za-z0-9+/]+"
ENDPOINT = r"(?:https?|postgres|postgresql|mysql|mongodb|redis|amqp)://[A-Za-z0-9._:@/?&=%-]+"
#: what must stand in a text for a pattern to have a valid match; cheap tests before the scans
MAY_HOLD = {
    "assign": r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6}""",
    "access": r"AKIA[A-Z0-9]{16}",
    "hex": r"[0-9a-f]{24}",
    "secret": r"[A-Za-z0-9+/]{40}",
    "endpoint": r"(?:https?|postgres|postgresql|mysql|mongodb|redis|amqp)://[A-Za-z0-9._:@/?&=%-]",
}
#: what a match must look like to count
VALID = {
    "assign": r"""(?i)^(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6}""",
    "access": r"^.{20}",
    "hex": r"^.{24}",
    "secret": r"^(?=.*[A-Z])(?=.*[a-z])(?=.*[0-9]).{40}$",
    "endpoint": r"^.",
}
KINDS = ["assign", "access", "hex", "secret", "endpoint"]


SPANS = "array<struct<start:int,kind:int,end:int>>"  # in the order in which spans are listed
CHUNK = 128


def _spans(text: Column, kind: str, pattern: str) -> Column:
    """SPANS of the matches of ``pattern`` that count.

    Positions are sums of the lengths before them. They are summed in chunks, and chunks over the sums of chunks, because
    an array that grows by one element is copied each time: a text of a million matches must not take their square.
    """
    valid = VALID[kind]
    empty = F.array().cast(SPANS)
    # what a lambda takes from outside is evaluated for every element, so texts and matches come in as its elements
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))
    sizes = F.transform(pairs, lambda p: F.struct(F.char_length(p["gap"]).alias("gap"), F.coalesce(F.char_length(p["match"]), F.lit(0)).alias("match"), F.coalesce(p["match"].rlike(valid), F.lit(False)).alias("ok")))
    parts = F.transform(F.array(sizes), lambda all_: F.transform(F.sequence(F.lit(1), F.size(all_), F.lit(CHUNK)), lambda i: F.slice(all_, i, CHUNK)))

    def walk(part: Column) -> Column:
        """The length of a chunk, and its spans by positions in it."""
        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + x["gap"]
            end = start + x["match"]
            span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"))
            return F.struct(end.alias("at"), F.when(x["ok"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

        return F.aggregate(part, F.struct(F.lit(0).alias("at"), empty.alias("spans")), step)

    def place(acc: Column, x: Column) -> Column:
        moved = F.transform(x["spans"], lambda s: F.struct((s["start"] + acc["at"]).alias("start"), s["kind"].alias("kind"), (s["end"] + acc["at"]).alias("end")))
        return F.struct((acc["at"] + x["at"]).alias("at"), F.when(F.size(x["spans"]) > 0, F.concat(acc["parts"], F.array(moved))).otherwise(acc["parts"]).alias("parts"))

    placed = F.aggregate(F.transform(F.flatten(parts), walk), F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPANS}>").alias("parts")), place)["parts"]
    return F.when(text.rlike(MAY_HOLD[kind]), F.flatten(placed)).otherwise(empty)


def _join(spans: Column) -> Column:
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row_no, base spans and weak candidates of every row."""
    text = F.col("text")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row_no"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = rows.select(
        "doc_id", "row_no",
        *(_spans(text, kind, pattern).alias(kind) for kind, pattern in zip(KINDS, (ASSIGN, ACCESS, HEX, SECRET, ENDPOINT), strict=True)),
    )
    return found.withColumn("base", F.sort_array(F.concat("assign", "access", "hex")))


def link(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """row_no and the weak candidates of each row that have a complementary part in scope and stand in no base finding."""
    weak_or_base = F.concat("base", "secret", "endpoint")
    rows = parts.where((F.size("secret") > 0) | (F.size("endpoint") > 0)).select("row_no", F.explode(weak_or_base).alias("s")).select("row_no", "s", (F.col("s.start") / scope).cast("int").alias("bin"))
    secret, endpoint, access, assign = (KINDS.index(k) for k in ("secret", "endpoint", "access", "assign"))
    partner = rows.select("row_no", F.col("bin").alias("near"), F.col("s.start").alias("at"), F.col("s.end").alias("upto"), F.col("s.kind").alias("role"))
    wanted = {secret: [access, endpoint], endpoint: [access, assign, secret]}
    weak = rows.where(F.col("s.kind").isin(secret, endpoint)).select(
        "row_no", "s", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("near"),
        reduce(lambda c, k: c.when(F.col("s.kind") == k, F.array(*map(F.lit, wanted[k]))), wanted, F).alias("roles"),
    ).select("row_no", "s", "near", F.explode("roles").alias("role"))
    close = (F.abs(weak["s.start"] - partner["at"]) <= scope) & (weak["row_no"] == partner["row_no"]) & (weak["near"] == partner["near"]) & (weak["role"] == partner["role"])
    linked = weak.join(partner, close, "left_semi").select("row_no", "s").distinct().withColumn("near", (F.col("s.start") / scope).cast("int"))
    # a candidate inside a base finding adds nothing; a finding covers the bins from its start to its end
    covers = F.explode(F.sequence("bin", (F.col("s.end") / scope).cast("int"))).alias("covers")
    base = rows.where(~F.col("s.kind").isin(secret, endpoint)).select(F.col("row_no").alias("of_row"), F.col("s").alias("found"), covers)
    inside = (F.col("row_no") == F.col("of_row")) & (F.col("near") == F.col("covers")) & (F.col("found.start") <= F.col("s.start")) & (F.col("s.end") <= F.col("found.end"))
    return linked.join(base, inside, "left_anti").groupBy("row_no").agg(F.collect_list("s").alias("linked"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans (base findings and linked candidates) for every row."""
    parts = materialise(find_parts(docs, id_col, text_col))
    count = lambda kind: F.size(kind).cast("long").alias(f"n_{kind}")
    every = F.sort_array(F.concat("base", F.coalesce("linked", F.array().cast(SPANS))))
    return parts.join(link(parts), "row_no", "left").select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(_join(F.col("base")), 256).alias("base_sha256"), _join(every).alias("spans"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents"))


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


ORACLE = f"""
WITH k(kind, ord, pat, may, ok) AS (VALUES
  ('assign', 0, {_literal(ASSIGN)}, {_literal(MAY_HOLD["assign"])}, {_literal(VALID["assign"])}),
  ('access', 1, {_literal(ACCESS)}, {_literal(MAY_HOLD["access"])}, {_literal(VALID["access"])}),
  ('hex', 2, {_literal(HEX)}, {_literal(MAY_HOLD["hex"])}, {_literal(VALID["hex"])}),
  ('secret', 3, {_literal(SECRET)}, {_literal(MAY_HOLD["secret"])}, '^.{{40}}$'),
  ('endpoint', 4, {_literal(ENDPOINT)}, {_literal(MAY_HOLD["endpoint"])}, '^.')
), d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents
), m AS (
  SELECT rid, kind, ord, ok, string_split_regex(t, pat) AS g, regexp_extract_all(t, pat) AS f FROM d, k WHERE regexp_matches(t, may)
), u AS (SELECT rid, kind, ord, ok, g, f, unnest(range(1, len(f) + 1)) AS i FROM m
), p AS (
  SELECT rid, kind, ord, ok, f[i] AS x,
    list_sum(list_transform(g[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda y: length(y))), 0) AS s
  FROM u
), q AS (
  SELECT rid, kind, ord, s, s + length(x) AS e FROM p WHERE regexp_matches(x, ok)
    AND (kind <> 'secret' OR (regexp_matches(x, '[A-Z]') AND regexp_matches(x, '[a-z]') AND regexp_matches(x, '[0-9]')))
), b AS (SELECT * FROM q WHERE ord < 3
), w AS (
  SELECT * FROM q WHERE ord >= 3
    AND EXISTS (SELECT 1 FROM q o WHERE o.rid = q.rid AND abs(o.s - q.s) <= {SCOPE}
      AND ((q.kind = 'secret' AND o.kind IN ('access', 'endpoint')) OR (q.kind = 'endpoint' AND o.kind IN ('access', 'assign', 'secret'))))
    AND NOT EXISTS (SELECT 1 FROM b WHERE b.rid = q.rid AND b.s <= q.s AND q.e <= b.e)
), n AS (
  SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(concat(kind, ':', CAST(s AS BIGINT), ':', CAST(e AS BIGINT)), ',' ORDER BY s, ord) AS base FROM b GROUP BY rid
), a AS (
  SELECT rid, string_agg(concat(kind, ':', CAST(s AS BIGINT), ':', CAST(e AS BIGINT)), ',' ORDER BY s, ord) AS spans FROM (SELECT * FROM b UNION ALL SELECT * FROM w) GROUP BY rid
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN n USING (rid) LEFT JOIN a USING (rid)
"""
