"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Candidates are found by kind: assign (a named assignment), access (access key ids), hex (long lower-case hex runs)
and, added by this module, pem (private key headers), provider (prefixed tokens of public providers) and jwt.
Positions come from splitting the text at the matches: gaps and matches alternate, so running sums of their lengths
(a window over the matches of a row, linear in their number) are the offsets, in code points, end exclusive.

The value of each candidate (of an assignment, what is assigned) is hashed, and the hashes are aggregated over the
corpus by distinct repositories and distinct owners. A value seen in more than max_owners owners is a widely copied
example; otherwise it is owner-specific and live-looking. Values that are one repeated character are examples too.

Defined cases: null text counts as empty; a null repository or owner counts as one repository or owner of its own;
repeated rows are scanned as rows of their own and add no owner; overlapping kinds are all reported; an empty
table gives no rows; a text of many matches costs in proportion to them; other columns of any name are kept by redact()
and ignored by scan().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakejobs.llm import common

#: A run of at least n characters is what is left of the maximal runs without the shorter ones, so the least lengths
#: of access and hex are in the patterns. An assignment of a short value still uses up its text, so its is not.
#: Kind, pattern, group that holds the value, least length of that group. In the order of the list.
BASE_KINDS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
ADDED_KINDS = (
    ("pem", r"-----BEGIN (?:[A-Z0-9]+ ){0,4}PRIVATE KEY-----", 0, 1),
    ("provider", r"(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35})", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
)
KINDS = BASE_KINDS + ADDED_KINDS
#: Owners that may share a value before it counts as a copied example.
MAX_OWNERS = 2

#: Code points of a chunk of a text that is masked; spans are cut at its ends.
CHUNK = 4096


def _hits(text: Column, kind_no: int, pattern: str, group: int) -> Column:
    """Array of (kind_no, code points since the match before, code points of the match, value) of the matches of one
    kind, leftmost and non-overlapping."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    both = F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(whole)).alias("gap"), whole.alias("hit"), values.alias("value"))
    return F.transform(both, lambda x: F.struct(F.lit(kind_no).alias("kind_no"), F.char_length(x["gap"]).alias("gap"), F.char_length(x["hit"]).alias("size"), x["value"].alias("value")))


def hits(text: Column) -> Column:
    """The matches of all kinds as one array, kind by kind; matches() turns them into spans."""
    body = F.coalesce(text, F.lit(""))
    none = F.array().cast("array<struct<kind_no:int,gap:int,size:int,value:string>>")
    return F.concat(*[F.when(body.rlike(pattern), _hits(body, i, pattern, group)).otherwise(none) for i, (_, pattern, group, _) in enumerate(KINDS)])


def matches(scanned: DataFrame) -> DataFrame:
    """(row, repository, owner, start, end, kind_no, value, value_sha256), a row per candidate of (row, repository, owner,
    hits). An end is the running sum of gaps and sizes within a row and a kind."""
    each = scanned.where(F.size("hits") > 0).select("row", "repository", "owner", F.posexplode("hits").alias("place", "h"))
    each = each.select("row", "repository", "owner", "place", "h.kind_no", (F.col("h.gap") + F.col("h.size")).alias("step"), "h.size", "h.value")
    end = F.sum("step").over(Window.partitionBy("row", "kind_no").orderBy("place")).cast("int")
    spans = each.withColumn("end", end).where(F.char_length("value") >= F.element_at(F.array(*[F.lit(least) for *_, least in KINDS]), F.col("kind_no") + 1))
    return spans.select("row", "repository", "owner", (F.col("end") - F.col("size")).alias("start"), "end", "kind_no", "value", F.sha2("value", 256).alias("value_sha256"))


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*[F.lit(k) for k, *_ in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind_no"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def ownership(found: DataFrame, max_owners: int = MAX_OWNERS) -> DataFrame:
    """(value_sha256, n_seen, n_repositories, n_owners, example) of candidates. Two grouped counts: the first, by value,
    owner and repository, is combined before its shuffle, so a value copied into a third of all rows is a few rows."""
    per = found.groupBy("value_sha256", "owner", "repository").agg(F.count("*").alias("n"))
    per = per.groupBy("value_sha256", "owner").agg(F.sum("n").alias("n"), F.count("*").alias("repositories"))
    out = per.groupBy("value_sha256").agg(F.sum("n").alias("n_seen"), F.sum("repositories").alias("n_repositories"), F.count("*").alias("n_owners"))
    return out.withColumn("example", F.col("n_owners") > max_owners)


def _judged(found: DataFrame, max_owners: int) -> DataFrame:
    """matches() with n_owners and live: whether a value looks live, being of few owners and not one repeated character.
    Values meet their counts in an equi-join that adaptive execution splits where one value is very frequent."""
    return found.join(ownership(found, max_owners), "value_sha256").withColumn("live", ~F.col("example") & ~F.col("value").rlike(r"^(.)\1*$"))


def scan(docs: DataFrame, id_column: str = "doc_id", text: str = "text", repository: str = "source", owner: str = "source", max_owners: int = MAX_OWNERS) -> DataFrame:
    """One row per document: (id, spans, n_live, n_example, most_owners); spans: array of (start, end, kind_no, value), by
    start, then kind. Documents without candidates take part in the last join only."""
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("id"), F.col(repository).alias("repository"), F.col(owner).alias("owner"), hits(F.col(text)).alias("hits"))
    base = common.saved(base, "secret-hits")
    judged = _judged(common.saved(matches(base), "secret-spans"), max_owners)
    per_row = judged.groupBy("row").agg(
        F.count_if("live").alias("n_live"), F.count_if(~F.col("live")).alias("n_example"), F.max("n_owners").alias("most_owners"),
        F.sort_array(F.collect_list(F.struct("start", "kind_no", "end", "value"))).alias("found"),
    )
    spans = F.transform(F.coalesce("found", F.array().cast("array<struct<start:int,kind_no:int,end:int,value:string>>")), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind_no"].alias("kind_no"), s["value"].alias("value")))
    zero = F.lit(0).cast("long")
    return base.select("row", "id").join(per_row, "row", "left").select(F.col("id").alias(id_column), spans.alias("spans"), *[F.coalesce(c, zero).alias(c) for c in ("n_live", "n_example", "most_owners")])


def _without_overlap(spans: DataFrame) -> DataFrame:
    """(row, start, end): spans of a row that overlap are one."""
    order = Window.partitionBy("row").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("first", (reach.isNull() | (F.col("start") >= reach)).cast("int"))
    return marked.withColumn("turn", F.sum("first").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy("row", "turn").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def _masked(text: Column, cuts: Column, mask: str) -> Column:
    """The text with its cuts (a map from chunk to the cuts in it) masked, chunk by chunk."""

    def cut(state: Column, s: Column, chunk: Column) -> Column:
        out = F.concat(state["out"], F.substring(chunk, state["at"] + 1, s["start"] - state["at"]), F.when(s["first"], F.lit(mask)).otherwise(""))
        return F.struct(s["end"].alias("at"), out.alias("out"))

    def one(chunk: Column, i: Column) -> Column:
        begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
        done = F.aggregate(F.try_element_at(cuts, i), begin, lambda state, s: cut(state, s, chunk), lambda state: F.concat(state["out"], F.substring(chunk, state["at"] + 1, F.lit(CHUNK))))
        return F.coalesce(done, chunk)

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)), one), "")


def redact(docs: DataFrame, text: str = "text", mask: str = "[SECRET]", repository: str = "source", owner: str = "source", max_owners: int = MAX_OWNERS) -> DataFrame:
    """The documents with every live-looking candidate cut out for the mask; widely copied examples stay.

    Documents without candidates pass by; only the others are joined, with their cuts by chunk of the text.
    """
    plain, (text, repository, owner) = common.by_place(docs, text, repository, owner)
    base = common.saved(plain.select("*", F.monotonically_increasing_id().alias("row"), hits(F.col(text)).alias("hits")), "secret-hits")
    found = matches(base.select("row", F.col(repository).alias("repository"), F.col(owner).alias("owner"), "hits"))
    spans = _without_overlap(_judged(common.saved(found, "secret-spans"), max_owners).where("live").select("row", "start", "end"))
    parts = spans.select("row", "start", "end", F.explode(F.sequence(*[F.floor(x / CHUNK).cast("int") for x in (F.col("start"), F.col("end") - 1)])).alias("chunk"))
    at = F.col("chunk") * CHUNK
    inside = F.struct(F.greatest(F.col("start") - at, F.lit(0)).alias("start"), F.least(F.col("end") - at, F.lit(CHUNK)).alias("end"), (F.col("start") >= at).alias("first"))
    by_chunk = parts.groupBy("row", "chunk").agg(F.sort_array(F.collect_list(inside)).alias("cuts"))
    by_row = by_chunk.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("chunk", "cuts"))).alias("cuts"))
    joined = base.where(F.size("hits") > 0).join(by_row, "row", "left")
    joined = joined.withColumn(text, F.when(F.col("cuts").isNull(), F.col(text)).otherwise(_masked(F.col(text), F.col("cuts"), mask)))
    return joined.select(*plain.columns).unionByName(base.where(F.size("hits") == 0).select(*plain.columns)).toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5_secret_scans: one row per document; source stands for both repository and owner."""
    found = scan(common.table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    base = F.filter("spans", lambda s: s["kind_no"] < len(BASE_KINDS))
    numbers = F.transform("spans", lambda s: s["kind_no"])
    count = [(F.size(numbers) - F.size(F.array_remove(numbers, i))).cast("long").alias(f"n_{k}") for i, (k, *_) in enumerate(BASE_KINDS)]
    return found.select("doc_id", *count, F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"), "n_live", "n_example", "most_owners")


#: DuckDB SQL of query(), its patterns and lengths written from the rules; places are running sums over lazy prefixes.
ORACLE_SQL = r"""
WITH kinds(kind_no, kind, part, pattern, least) AS (VALUES
    (0, 'assign', 4, '(?s)(.*?)(([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+))', 6),
    (1, 'access', 2, '(?s)(.*?)(AKIA[A-Z0-9]+)', 20),
    (2, 'hex', 2, '(?s)(.*?)([0-9a-f]+)', 24),
    (3, 'pem', 2, '(?s)(.*?)(-----BEGIN ([A-Z0-9]+ ){0,4}PRIVATE KEY-----)', 1),
    (4, 'provider', 2, '(?s)(.*?)(gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35})', 1),
    (5, 'jwt', 2, '(?s)(.*?)(eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})', 1)),
docs AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
lists AS (SELECT r, source, kind_no, kind, least, regexp_extract_all(t, pattern, 1) AS gaps, regexp_extract_all(t, pattern, 2) AS hits,
        CASE part WHEN 4 THEN regexp_extract_all(t, pattern, 4) ELSE regexp_extract_all(t, pattern, 2) END AS vals
    FROM docs, kinds),
each AS (SELECT r, source, kind_no, kind, least, unnest(range(len(hits))) AS n, unnest(gaps) AS gap, unnest(hits) AS hit, unnest(vals) AS v FROM lists),
placed AS (SELECT *, CAST(sum(length(gap) + length(hit)) OVER (PARTITION BY r, kind_no ORDER BY n) AS BIGINT) AS e FROM each),
found AS (SELECT r, source, kind_no, kind, v, e - length(hit) AS s, e FROM placed WHERE length(v) >= least),
stats AS (SELECT v, count(DISTINCT coalesce('s' || source, 'null')) AS owners FROM found GROUP BY v),
judged AS (SELECT f.*, owners, owners > 2 OR v = repeat(v[1:1], length(v)) AS example FROM found f JOIN stats USING (v)),
per AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, kind_no) FILTER (kind_no < 3), '')) AS base_sha256,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, kind_no) AS spans,
    count(*) FILTER (NOT example) AS n_live, count(*) FILTER (example) AS n_example, max(owners) AS most_owners
    FROM judged GROUP BY r)
SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex,
    coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans,
    CAST(coalesce(n_live, 0) AS BIGINT) AS n_live, CAST(coalesce(n_example, 0) AS BIGINT) AS n_example, CAST(coalesce(most_owners, 0) AS BIGINT) AS most_owners
FROM docs LEFT JOIN per USING (r)
"""
