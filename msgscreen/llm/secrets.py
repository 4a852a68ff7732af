"""Secret scan: base patterns, plus ownership frequency over the corpus. DataFrame functions only.

Base spans come from three published patterns. The candidates of the method are
long opaque tokens (letters and digits mixed). Every candidate and every base value
is hashed, and hashes are counted by distinct repositories and owners: a value that
many owners hold is a copied example, one that few hold looks live. Live opaque
tokens become further spans; base spans stay whatever their class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import quoted
from .common import stored, text_or_empty

# Fixed values of the contract. Lengths are tested after matching, as stated there.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"  # the same matches as [0-9a-f]+ of 32 or more: both take whole runs
ASSIGN_VALUE, ACCESS_LENGTH = 8, 16
KINDS = ("assign", "access", "hex", "opaque")  # in the order in which equal starts are listed
# Ours: a run of 20 or more token characters. It is opaque with digits and letters of both cases, or, of one case only,
# if it has no signs, three digits and ten different characters: upper-case hex, lower-case base 36.
OPAQUE = r"[A-Za-z0-9+/_-]{20,}"
ONE_CASE = r"^(?:[a-z0-9]+|[A-Z0-9]+)$"
ONE_CASE_DIGITS, ONE_CASE_KINDS = 3, 10
PIECE = "struct<rank:int,pos:int,gap:int,len:int,hash:binary>"
SPAN = "struct<start:int,rank:int,end:int>"


def pieces(text: str, pattern: str, rank: int, value_group: int, where: str) -> str:
    """All leftmost non-overlapping matches of a text as an array of PIECE; the hash is null where ``where`` fails.

    Spark gives matches and the gaps before them, not offsets; those are running
    sums, taken later. Texts without a match skip all this.
    """
    q = quoted(pattern)
    whole = f"regexp_extract_all({text}, {q}, 0)"
    value = f"regexp_extract_all({text}, {q}, {value_group})" if value_group else whole
    pairs = f"zip_with({whole}, {value}, (m, v) -> named_struct('m', m, 'v', v))"
    gaps = f"slice(split({text}, {q}, -1), 1, size({whole}))"
    zipped = f"zip_with({pairs}, {gaps}, (y, g) -> named_struct('m', y.m, 'v', y.v, 'g', g))"
    piece = f"""transform({zipped}, (x, i) -> cast(named_struct('rank', {rank}, 'pos', i, 'gap', length(x.g),
        'len', length(x.m), 'hash', case when {where} then unhex(sha2(x.v, 256)) end) as {PIECE}))"""
    return f"case when rlike({text}, {q}) then {piece} else cast(array() as array<{PIECE}>) end"


def scan_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    repo_col: str = "source",
    owner_col: str = "source",
    example_owners: int = 3,
    example_repos: int = 3,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Per row ``id, base, added`` (sorted arrays of SPAN), ``n_example, n_live`` of its values, and the columns ``keep``.

    A value is an example when ``example_owners`` owners or ``example_repos``
    repositories (named within their owner) hold it, else live. Where one column stands
    for both, as by default, the two counts are one and the first limit decides. Null texts are
    empty; null repositories and owners count as one unnamed one; null and repeated
    ids are kept as they are. Of the other columns only ``keep`` are read, inside
    one struct, so no name can clash. An empty table gives an empty result.

    A value copied all over the corpus combines before each shuffle, and the join
    of verdicts has one row a value on its other side, so a hot one can be split.
    """
    texts = docs.select(
        F.col(id_col).alias("id"),
        text_or_empty(F.col(text_col)).alias("text"),
        F.coalesce(F.col(repo_col).cast("string"), F.lit("")).alias("repo"),
        F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"),
        F.struct(*(F.col(c) for c in keep) if keep else [F.lit(0).alias("_")]).alias("kept"),
    )
    both_cases = "rlike(x.v, '[a-z]') and rlike(x.v, '[A-Z]')"
    one_case = (
        f"rlike(x.v, '{ONE_CASE}') and length(regexp_replace(x.v, '[^0-9]', '')) between {ONE_CASE_DIGITS} and length(x.v) - 1"
        f" and size(array_distinct(split(x.v, ''))) >= {ONE_CASE_KINDS}"
    )
    opaque = f"rlike(x.v, '[0-9]') and (({both_cases}) or ({one_case}))"
    found = [
        pieces("text", ASSIGN, 0, 1, f"length(x.v) >= {ASSIGN_VALUE}"),
        pieces("text", ACCESS, 1, 0, f"length(x.v) >= {ACCESS_LENGTH}"),
        pieces("text", HEX, 2, 0, "true"),
        pieces("text", OPAQUE, 3, 0, opaque),
    ]
    scanned = texts.select("id", "repo", "owner", "kept", F.expr(f"concat({', '.join(found)})").alias("pieces"))
    scanned = stored(scanned.withColumn("row_id", F.monotonically_increasing_id()), "secrets-scanned")

    each = scanned.where("size(pieces) > 0").select("row_id", "repo", "owner", F.explode("pieces").alias("p"))
    so_far = Window.partitionBy("row_id", "p.rank").orderBy("p.pos")
    placed = each.select("row_id", "repo", "owner", "p", F.sum(F.expr("p.gap + p.len")).over(so_far).cast("int").alias("end"))
    placed = placed.where("p.hash is not null").selectExpr(
        "row_id", "repo", "owner", "p.rank as rank", "p.hash as hash", "end - p.len as start", "end"
    )
    # An opaque token that overlaps a base span adds nothing.
    in_row = Window.partitionBy("row_id").orderBy("start", "rank")
    before = in_row.rowsBetween(Window.unboundedPreceding, -1)
    after = in_row.rowsBetween(1, Window.unboundedFollowing)
    base_end, base_start = F.expr("case when rank < 3 then end end"), F.expr("case when rank < 3 then start end")
    placed = placed.withColumns({"reach": F.max(base_end).over(before), "next": F.min(base_start).over(after)})
    spans = placed.where("rank < 3 or (coalesce(reach, 0) <= start and coalesce(next, end) >= end)").drop("reach", "next")
    spans = stored(spans, "secrets-spans")

    by_repo = spans.groupBy("hash", "owner", "repo").agg(F.lit(1).alias("one"))
    by_owner = by_repo.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"))
    spread = by_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repos"))
    example = (F.col("owners") >= example_owners) | (F.col("repos") >= example_repos)
    verdicts = stored(spread.select("hash", example.alias("example")), "secrets-values")
    span = F.struct("start", "rank", "end")
    per_row = (
        spans.join(verdicts, "hash")
        .groupBy("row_id")
        .agg(
            F.count_if("example").alias("n_example"),
            F.count_if(~F.col("example")).alias("n_live"),
            F.sort_array(F.collect_list(F.when(F.col("rank") < 3, span))).alias("base"),
            F.sort_array(F.collect_list(F.when((F.col("rank") == 3) & ~F.col("example"), span))).alias("added"),
        )
    )
    none = F.expr(f"cast(array() as array<{SPAN}>)")
    joined = scanned.select("row_id", "id", "kept").join(per_row, "row_id", "left")
    return joined.select(
        "id",
        F.coalesce("base", none).alias("base"),
        F.coalesce("added", none).alias("added"),
        F.coalesce("n_example", F.lit(0)).alias("n_example"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"),
        *(F.col("kept")[c].alias(c) for c in keep),
    )


def listed(spans: str) -> str:
    """``kind:start:end`` by start, then kind as in KINDS, comma-joined."""
    names = ", ".join(f"'{k}'" for k in KINDS)
    item = f"concat(element_at(array({names}), x.rank + 1), ':', x.start, ':', x.end)"
    return f"array_join(transform({spans}, x -> {item}), ',')"


def span_digest(found: DataFrame) -> DataFrame:
    """The counts and digests of the contract, one row per scanned row."""
    count = lambda rank: F.expr(f"cast(size(filter(base, x -> x.rank = {rank})) as bigint)")
    return found.select(
        F.col("id").alias("doc_id"),
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(F.expr(listed("base")).cast("binary"), 256).alias("base_sha256"),
        F.expr(listed("sort_array(concat(base, added))")).alias("spans"),
        "n_example",
        "n_live",
    )


def redact(text: str, spans: str, mask: str = "[SECRET]") -> Column:
    """The text with every run of touching or overlapping spans (sorted) replaced by the mask."""
    folded = f"""aggregate({spans}, named_struct('at', 0, 'cut', cast(array() as array<string>)),
        (s, x) -> named_struct('at', greatest(s.at, x.end), 'cut', case when x.start >= s.at
          then array_append(s.cut, substring({text}, s.at + 1, x.start - s.at)) else s.cut end),
        s -> concat(array_join(s.cut, '{mask}'), '{mask}', substring({text}, s.at + 1)))"""
    return F.expr(f"case when size({spans}) > 0 then {folded} else {text} end")
