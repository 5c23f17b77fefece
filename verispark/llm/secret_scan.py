"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Base spans come from three patterns. Candidates beyond them are runs of at least LONG token
characters with upper-case, lower-case letters and digits. Each secret's hash is counted over the
corpus by distinct documents (repositories) and sources (owners). A string that COPIED or more
owners hold is a widely copied example; one that a single owner holds is a live-looking
credential; what fewer than COPIED owners share is a class of its own. Candidates that look live and
shared ones are added to the spans, widely copied ones aren't; base spans always stay.

Positions are in code points: between the matches of a pattern lie the pieces that split() gives,
so starts are running sums of both lengths. Rows are numbered after a checkpoint, so rows that
repeat an id, or have none, keep their own spans.

Defined results: null text is the empty text; a null owner or repository isn't counted; rows that
repeat an id and text have the same spans; of spans with one start, kinds go in the order of KINDS;
a very long text costs in proportion to its length and a sort of its matches; an empty table gives
no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import checkpointed, text_of

#: The patterns, and the least length of a match (assign: of its second group). A run that
#: is long enough starts where it starts without the bound, so access and hex can carry it; assign can't.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = {"assign": (ASSIGN, 2, 8), "access": (ACCESS, 0, 16), "hex": (HEX, 0, 32)}
#: Least length of a candidate of the method, and owners from which a string is a copied example.
LONG = 20
COPIED = 3
GENERIC = rf"[A-Za-z0-9+/_=-]{{{LONG},}}"
#: What must occur for a pattern to match; a cheap test that spares most texts the rest.
_MAY = {"assign": r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{8}", "access": ACCESS, "hex": HEX, "generic": GENERIC}
_SPAN = "array<struct<start: bigint, kind: int, end: bigint, secret: string>>"
_HELD = "array<struct<start: bigint, kind: int, end: bigint, n_repositories: bigint, n_owners: bigint>>"
_MATCH = "array<struct<kind: int, at: int, gap: bigint, size: bigint, secret: string>>"


def _matches(text: Column, pattern: str, group: int, rank: int, may: str) -> Column:
    """All matches of a pattern: their rank of kind, number, distance from the one before, length and secret."""
    p = F.lit(pattern)
    whole, secret = F.regexp_extract_all(text, p, F.lit(0)), F.regexp_extract_all(text, p, F.lit(group))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole))
    size = lambda c: F.char_length(c).cast("long")
    found = F.transform(F.arrays_zip(whole.alias("m"), secret.alias("s"), gaps.alias("g")), lambda x, i: F.struct(F.lit(rank).alias("kind"), i.alias("at"), size(x["g"]).alias("gap"), size(x["m"]).alias("size"), x["s"].alias("secret")))
    return F.when(text.rlike(may), found).otherwise(F.array().cast(_MATCH))


def found_spans(rows: DataFrame) -> DataFrame:
    """row_id, repository, owner, start, kind, end, secret: base spans, and candidates that touch none.

    rows has row_id and matches. Positions and overlaps are running sums and extremes over a row's
    matches, so a text with many matches costs a sort of them and no comparison of pairs.
    """
    least = F.element_at(F.array(*(F.lit(n) for _, _, n in KINDS.values()), F.lit(LONG)), F.col("kind") + 1)
    mixed = F.col("secret").rlike("[A-Z]") & F.col("secret").rlike("[a-z]") & F.col("secret").rlike("[0-9]")
    upto = Window.partitionBy("row_id", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = rows.where(F.size("matches") > 0).select("row_id", "repository", "owner", F.explode("matches").alias("m")).select("row_id", "repository", "owner", "m.*")
    each = each.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(upto)).withColumn("start", F.col("end") - F.col("size"))
    is_base = F.col("kind") < len(KINDS)
    each = each.where((F.char_length("secret") >= least) & (is_base | mixed))
    forth, back = (Window.partitionBy("row_id").orderBy(o).rangeBetween(Window.unboundedPreceding, Window.currentRow) for o in (F.asc("start"), F.desc("start")))
    each = each.withColumns({"reach": F.max(F.when(is_base, F.col("end"))).over(forth), "next": F.min(F.when(is_base, F.col("start"))).over(back)})
    touches = F.coalesce(F.col("reach") > F.col("start"), F.lit(False)) | F.coalesce(F.col("next") < F.col("end"), F.lit(False))
    return each.where(is_base | ~touches).select("row_id", "repository", "owner", "start", "kind", "end", "secret")


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*(F.lit(k) for k in [*KINDS, "generic"]))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def ownership(spans: DataFrame) -> DataFrame:
    """secret_hash, n_repositories, n_owners: over rows (secret_hash, repository, owner).

    Distinct pairs are formed before the shuffle on the hash, so a string that is copied into a
    third of all rows arrives as one row per task and repository or owner.
    """
    by = [spans.select("secret_hash", F.col(c).cast("string").alias("who")).where("who IS NOT NULL").distinct().groupBy("secret_hash").agg(F.count("*").alias(n)) for c, n in (("repository", "n_repositories"), ("owner", "n_owners"))]
    return by[0].join(by[1], "secret_hash", "full").na.fill(0)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository_col: str = "doc_id", owner_col: str = "source", copied: int = COPIED) -> DataFrame:
    """doc_id, base, added, shared, held, n_copied, n_live, n_shared: one row per row of docs.

    base, added and shared are arrays of (start, kind, end, secret); n_copied, n_live and n_shared
    count the spans whose secret is a widely copied example, held by a single owner, or by some
    owners fewer than copied. Candidates of the last class are in shared. held has (start, kind,
    end, n_repositories, n_owners) of every base span and candidate; owners alone decide the class.
    """
    text = text_of(text_col)
    kinds = [(p, g, _MAY[name]) for name, (p, g, _) in KINDS.items()] + [(GENERIC, 0, _MAY["generic"])]
    matches = F.concat(*(_matches(text, p, g, k, may) for k, (p, g, may) in enumerate(kinds)))
    # matches without their texts, so the patterns run once over the corpus; a checkpoint's rows have fixed places and so fixed numbers
    rows = checkpointed(docs.select(F.col(id_col).alias("doc_id"), F.col(repository_col).alias("repository"), F.col(owner_col).alias("owner"), matches.alias("matches"))).withColumn("row_id", F.monotonically_increasing_id())
    each = checkpointed(found_spans(rows).withColumn("secret_hash", F.md5("secret")))
    known = each.join(ownership(each.select("secret_hash", "repository", "owner")), "secret_hash")
    span, generic = F.struct("start", "kind", "end", "secret"), F.col("kind") == len(KINDS)
    live = F.col("n_owners") <= 1
    shared = ~live & (F.col("n_owners") < copied)
    # a document's spans only: bounded by its own text
    per_row = known.groupBy("row_id").agg(
        *(F.array_sort(F.collect_list(F.when(c, span))).alias(name) for name, c in (("base", ~generic), ("added", generic & live), ("shared", generic & shared))),
        F.array_sort(F.collect_list(F.struct("start", "kind", "end", "n_repositories", "n_owners"))).alias("held"),
        F.count_if(F.col("n_owners") >= copied).alias("n_copied"), F.count_if(live).alias("n_live"), F.count_if(shared).alias("n_shared"),
    )
    out = rows.select("doc_id", "row_id").join(per_row, "row_id", "left")
    spans, counts = {"base": _SPAN, "added": _SPAN, "shared": _SPAN, "held": _HELD}, ("n_copied", "n_live", "n_shared")
    return out.select("doc_id", *(F.coalesce(c, F.array().cast(t)).alias(c) for c, t in spans.items()), *(F.coalesce(c, F.lit(0)).alias(c) for c in counts))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base spans, and the candidates that aren't widely copied."""
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        written(F.array_sort(F.concat("base", "added", "shared"))).alias("spans"), "n_copied", "n_live", "n_shared",
    )


def _spelt_out(pattern: str) -> str:
    """The pattern with both cases of each letter where it ignores case: DuckDB would take letters beyond ASCII for them, Spark doesn't."""
    return re.sub(r"\(\?i:([^)]*)\)", lambda m: "(?:" + re.sub("[a-z]", lambda c: f"[{c[0].upper()}{c[0]}]", m[1]) + ")", pattern)


def _sql_kind(rank: int, pattern: str, group: int, least: int) -> str:
    p = "'" + _spelt_out(pattern).replace("'", "''") + "'"
    return f"SELECT doc_id, source, {rank} AS kind, {least} AS least, regexp_extract_all(t, {p}, 0) AS m, regexp_extract_all(t, {p}, {group}) AS s, string_split_regex(t, {p}) AS g FROM d"


_SQL_LEN = "coalesce(list_sum(list_transform({x}, lambda x: length(x))), 0)"
OP9_SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
raw AS ({" UNION ALL ".join(_sql_kind(k, *v) for k, v in enumerate([*KINDS.values(), (GENERIC, 0, LONG)]))}),
one AS (SELECT doc_id, source, kind, least, m, s, g, unnest(range(1, len(m) + 1)) AS i FROM raw),
kept AS (SELECT * FROM one WHERE length(s[i]) >= least AND (kind < 3 OR (regexp_matches(s[i], '[A-Z]') AND regexp_matches(s[i], '[a-z]') AND regexp_matches(s[i], '[0-9]')))),
sp AS (SELECT doc_id, source, kind, CAST({_SQL_LEN.format(x="g[1:i]")} + {_SQL_LEN.format(x="m[1:i-1]")} AS BIGINT) AS a, length(m[i]) AS n, s[i] AS secret FROM kept),
base AS (SELECT * FROM sp WHERE kind < 3),
every AS (SELECT * FROM base UNION ALL SELECT * FROM sp c WHERE kind = 3 AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = c.doc_id AND b.a < c.a + c.n AND c.a < b.a + b.n)),
own AS (SELECT secret, count(DISTINCT source) AS owners FROM every GROUP BY 1),
w AS (SELECT doc_id, kind, a, e.n, owners, ['assign', 'access', 'hex', 'generic'][kind + 1] || ':' || a || ':' || (a + e.n) AS txt FROM every e JOIN own ON own.secret = e.secret),
r AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    coalesce(string_agg(txt, ',' ORDER BY a, kind) FILTER (kind < 3), '') AS base, coalesce(string_agg(txt, ',' ORDER BY a, kind) FILTER (kind < 3 OR owners < {COPIED}), '') AS spans,
    count(*) FILTER (owners >= {COPIED}) AS n_copied, count(*) FILTER (owners <= 1) AS n_live, count(*) FILTER (owners > 1 AND owners < {COPIED}) AS n_shared FROM w GROUP BY 1
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_copied, 0) AS n_copied, coalesce(n_live, 0) AS n_live, coalesce(n_shared, 0) AS n_shared
FROM d LEFT JOIN r ON r.doc_id = d.doc_id
"""
