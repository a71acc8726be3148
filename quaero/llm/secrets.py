"""Secrets in texts: fixed patterns, and strings that a battery of tests finds random.

DataFrame functions only.  A candidate is a long run of encoding characters with letters and
digits.  Its encoding (hex, base 32, 36, 62, 64) follows from its characters.  Three tests ask
whether its symbols look drawn at random: chi-squared uniformity over the alphabet, runs above and
below the middle of the alphabet, correlation of neighbours.  A candidate that fails them jointly
is structured and never reported.  For the others two of the statistics are held against ordinary
text: the chi-squared one, which grows with the length there, and the runs of letters, digits and
capitals, of which ordinary text has few.  The joint p-values, strict for long strings and weak for
short ones, pass Benjamini and Hochberg's step-up rule within strata of one encoding and like
length, with Storey's estimate of how many of a stratum's candidates are ordinary text: where
nothing else looks like an encoding, a short key of it is enough.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from quaero.functions.arrays import exploded
from quaero.sources.workdir import run_dir, staged

# The patterns of the base kinds, and the least length of what must be that long.
ASSIGN = (r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|"
          r"[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = "AKIA[A-Z0-9]{16,}"   # a shorter match has no longer one inside, so the bound may stand here
HEX = "(?<![0-9a-f])[0-9a-f]{24,}"
ASSIGN_CHARS = 6
KINDS = ("assign", "access", "hex", "random")

ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}


@dataclass(frozen=True)
class SecretParams:
    min_chars: int = 20          # of a candidate
    structured: float = 1e-3     # joint p-value of the battery under which a string isn't random
    discovery: float = 0.01      # false-discovery rate within a stratum of lengths
    text_coincidence: float = 0.065  # chance that two characters of ordinary text are equal
    hex_coincidence: float = 0.1     # the same for ordinary runs of hex digits
    text_changes: float = 0.15       # chance that ordinary text turns from letters to digits, back, or to a capital,
                                     # or, where it has small letters, has a capital after a capital
    doubtful: float = 0.05           # p-value against ordinary text above which nothing is reported


def _found(text: Column, pattern: str, kind: int) -> Column:
    """Matches in order with the number of characters between each and the one before."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    each = F.transform(F.arrays_zip(matches.alias("m"), gaps.alias("g")),
                       lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("pos"), x["g"].alias("gap"), x["m"].alias("match")))
    return F.when(text.rlike(pattern), F.filter(each, lambda x: x["match"].isNotNull()))


def _places(rows: DataFrame) -> DataFrame:
    """``row, kind, start, end, match`` of all matches: places are running sums within a text."""
    each = exploded(rows, ["row"], F.col("found"), "x").select("row", "x.*")
    so_far = Window.partitionBy("row", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    n = F.length("match").cast("long")
    return (each.withColumn("end", F.sum(F.col("gap") + n).over(so_far))
            .select("row", "kind", (F.col("end") - n).alias("start"), "end", "match"))


def _erfc(x: Column) -> Column:
    """Complementary error function for x >= 0 (Abramowitz and Stegun 7.1.26)."""
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)


def _below(z: Column) -> Column:
    """Chance that a standard normal value is below z."""
    half = _erfc(F.abs(z) / F.lit(2.0 ** 0.5)) / 2
    return F.when(z < 0, half).otherwise(1 - half)


def _battery(candidates: DataFrame, p: SecretParams) -> DataFrame:
    """Adds ``encoding, p_random, p_text`` to rows with a ``match``."""
    m = F.col("match")
    encoding = (
        F.when(m.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex")
        .when(m.rlike("^[A-Z2-7]+=*$"), "base32")
        .when(m.rlike("^([a-z0-9]+|[A-Z0-9]+)$"), "base36")
        .when(m.rlike("^[A-Za-z0-9]+$"), "base62")
        .otherwise("base64"))
    alphabet = F.create_map(*[F.lit(x) for pair in ALPHABETS.items() for x in pair])[F.col("encoding")]
    symbols = F.when(F.col("encoding").isin("hex", "base36"), F.lower(m)).otherwise(F.translate(m, "-_=", "+/"))
    rows = (candidates.withColumn("encoding", encoding).withColumn("alphabet", alphabet).withColumn("symbols", symbols)
            .withColumn("k", F.length("alphabet").cast("double")).withColumn("n", F.length("symbols").cast("double"))
            .withColumn("at", F.expr("transform(split(symbols, ''), c -> cast(instr(alphabet, c) as double))")))
    squares = F.expr("aggregate(split(alphabet, ''), 0D, (a, c) -> a + pow(n - length(replace(symbols, c, '')), 2))")
    rows = rows.withColumn("chi", F.col("k") / F.col("n") * squares - F.col("n"))
    # The runs test, above and below the middle of the alphabet.
    rows = rows.withColumn("high", F.expr("transform(at, x -> x > k / 2)")).withColumn(
        "n1", F.expr("cast(size(filter(high, x -> x)) as double)")).withColumn(
        "runs", F.expr("1D + size(filter(transform(sequence(2, size(high)), i -> high[i - 1] != high[i - 2]), x -> x))"))
    rows = rows.withColumn("c", F.expr("2 * n1 * (n - n1)")).withColumn("mean", F.expr("aggregate(at, 0D, (a, x) -> a + x) / n"))
    runs_var = F.expr("c * (c - n) / (n * n * (n - 1))")
    z_runs = F.when(runs_var > 0, (F.col("runs") - 1 - F.col("c") / F.col("n")) / F.sqrt(runs_var)).otherwise(F.lit(40.0))
    spread = F.expr("aggregate(at, 0D, (a, x) -> a + (x - mean) * (x - mean))")
    lag = F.expr("aggregate(transform(sequence(2, size(at)), i -> (at[i - 1] - mean) * (at[i - 2] - mean)), 0D, (a, x) -> a + x)")
    z_lag = F.when(spread > 0, (lag / spread + 1 / F.col("n")) * F.sqrt("n")).otherwise(F.lit(40.0))
    df = F.col("k") - 1
    z_chi = (F.col("chi") - df) / F.sqrt(2 * df * (F.col("n") - 1) / F.col("n"))
    tiny = 1e-300
    logs = sum(-2 * F.log(F.greatest(x, F.lit(tiny))) for x in (
        1 - _below(F.least(z_chi, F.lit(8.0))), _erfc(F.abs(z_runs) / F.lit(2.0 ** 0.5)), _erfc(F.abs(z_lag) / F.lit(2.0 ** 0.5))))
    half = F.col("fisher") / 2  # chi-squared with six degrees of freedom
    coincidence = F.when(F.col("encoding") == "hex", p.hex_coincidence).otherwise(p.text_coincidence)
    excess = (F.col("n") - 1) * (F.col("k") * coincidence - 1)
    z_text = (F.col("chi") - df - excess) / F.sqrt(2 * df + 4 * excess)
    rows = rows.withColumn("fisher", logs).withColumn("p_random", F.exp(-half) * (1 + half + half * half / 2))
    plain = F.regexp_replace(m, "[^A-Za-z0-9]", "")
    turns = "(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[a-z])(?=[A-Z])"
    changes = F.when(m.rlike("[a-z]"), F.regexp_count(plain, F.lit(turns + "|(?<=[A-Z])(?=[A-Z])"))).otherwise(
        F.regexp_count(plain, F.lit(turns)))
    rows = rows.withColumn("steps", F.greatest(F.length(plain) - 1, F.lit(1))).withColumn("changes", changes)
    logs = F.log(F.greatest(_below(z_text), F.lit(tiny))) + F.log(F.greatest(_many(F.col("steps"), F.col("changes"), p.text_changes), F.lit(tiny)))
    return rows.withColumn("half", -logs).withColumn(  # chi-squared with four degrees of freedom
        "p_text", F.greatest(F.exp(-F.col("half")) * (1 + F.col("half")), F.lit(tiny)))


def _many(n: Column, x: Column, chance: float) -> Column:
    """Chance of ``x`` or more hits in ``n`` tries; Chernoff's bound beyond 400 tries."""
    odds = chance / (1 - chance)
    first = F.struct(F.pow(F.lit(1 - chance), n).alias("at"), F.when(x <= 0, F.pow(F.lit(1 - chance), n)).otherwise(0.0).alias("total"))

    def step(acc, i):
        at = acc["at"] * (n - i + 1) / i * odds
        return F.struct(at.alias("at"), (acc["total"] + F.when(i >= x, at).otherwise(0.0)).alias("total"))

    exact = F.aggregate(F.sequence(F.lit(1), F.least(n, F.lit(400))), first, step, lambda acc: F.least(acc["total"], F.lit(1.0)))
    share = F.least(x / n, F.lit(1 - 1e-9))
    bound = F.exp(-n * (share * F.log(share / chance) + (1 - share) * F.log((1 - share) / (1 - chance))))
    return F.when(n <= 400, exact).when(share > chance, bound).otherwise(1.0)


def _discovered(tested: DataFrame, p: SecretParams) -> DataFrame:
    """Benjamini and Hochberg by stratum, on p-values rounded up to a tenth of a decade."""
    p_text = F.when(F.col("p_random") >= p.structured, F.col("p_text")).otherwise(1.0)
    tested = tested.withColumn("step", F.least(F.floor(-10 * F.log10(p_text)), F.lit(400)).cast("long")).withColumn(
        "stratum", F.concat_ws("/", "encoding", F.floor(F.log2("n")).cast("string")))
    counts = tested.groupBy("stratum", "step").agg(F.count("*").alias("rows"))  # at most 401 rows a stratum
    up = Window.partitionBy("stratum").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("stratum")
    # Ordinary text has a p-value above one half (step 3) as often as not.
    ordinary = 2 * (1 + F.sum(F.when(F.col("step") < 3, F.col("rows")).otherwise(0)).over(whole))
    counts = counts.withColumn("rank", F.sum("rows").over(up)).withColumn("ordinary", F.least(ordinary, F.sum("rows").over(whole)))
    value = F.pow(F.lit(10.0), -F.col("step") / 10)
    passed = counts.filter((value * F.col("ordinary") <= p.discovery * F.col("rank")) & (value <= p.doubtful))
    bars = passed.groupBy("stratum").agg(F.min("step").alias("bar"))  # a row for each encoding and power of two
    return tested.join(F.broadcast(bars), "stratum").filter("step >= bar")


def find_secrets(docs: DataFrame, params: SecretParams = SecretParams(), key: str = "doc_id", text: str = "text",
                 folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``rows`` (row, id, digest) and ``spans`` (row, kind, start, end): kind is a place in `KINDS`.

    Places count code points of the whole text, the end exclusive.  Within a kind, matches are
    leftmost and don't overlap.  Random strings that touch a base span are not reported again.
    Null and empty texts have no spans.  Each repeated row has a ``row`` of its own.  Columns other
    than ``key`` and ``text`` are not read; ``digest`` is the MD5 of the text.
    """
    p = params
    folder = folder or run_dir(docs.sparkSession, "secrets")
    candidate = "(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}+" % p.min_chars
    t = F.col("t")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("id"),
                       F.md5(F.col(text)).alias("digest"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    empty = F.array().cast("array<struct<kind:int,pos:int,gap:int,match:string>>")
    found = F.concat(*[F.coalesce(_found(t, x, i), empty) for i, x in enumerate((ASSIGN, ACCESS, HEX, candidate))])
    rows = staged(rows.select("row", "id", "digest", found.alias("found")), "found", folder)
    places = _places(rows)
    value = F.regexp_extract("match", ASSIGN, 1)
    base = places.filter(F.col("kind") < 3).filter((F.col("kind") > 0) | (F.length(value) >= ASSIGN_CHARS))
    mixed = places.filter("kind = 3").filter(F.col("match").rlike("[0-9]") & F.col("match").rlike("[A-Za-z]"))
    tested = staged(_battery(mixed, p).select("row", "kind", "start", "end", "n", "encoding", "p_random", "p_text"), "tested", folder)
    names = ("row", "kind", "start", "end")
    spans = base.select(*names).unionByName(_discovered(tested, p).select(*names))
    # A random span goes if a base span of the row ends after its start or begins before its end.
    upto = Window.partitionBy("row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("row").orderBy("start", "kind").rowsBetween(1, Window.unboundedFollowing)
    is_base = F.col("kind") < 3
    spans = spans.withColumn("_before", F.max(F.when(is_base, F.col("end"))).over(upto)).withColumn(
        "_next", F.min(F.when(is_base, F.col("start"))).over(after))
    touched = F.coalesce(F.col("_before") > F.col("start"), F.lit(False)) | F.coalesce(F.col("_next") < F.col("end"), F.lit(False))
    spans = staged(spans.filter(is_base | ~touched).select(*names), "spans", folder)
    return rows.select("row", "id", "digest"), spans


def _listed(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    each = F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", names[x["kind"]], x["start"], x["end"]))
    return F.array_join(each, ",")


def secret_report(docs: DataFrame, params: SecretParams = SecretParams(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id, n_assign, n_access, n_hex, n_random, base_sha256, spans``."""
    rows, spans = find_secrets(docs, params, key, text)
    span = F.struct("start", "kind", "end")
    kind = F.col("kind")
    by_row = spans.groupBy("row").agg(
        *[F.count(F.when(kind == i, 1)).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.collect_list(F.when(kind < 3, span)).alias("base"), F.collect_list(span).alias("every"))
    joined = rows.join(by_row, "row", "left")
    none = F.lit("")
    return joined.select(
        "id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.coalesce(_listed(F.col("base")), none), 256).alias("base_sha256"),
        F.coalesce(_listed(F.col("every")), none).alias("spans"))


def redact(docs: DataFrame, params: SecretParams = SecretParams(), key: str = "doc_id", text: str = "text",
           mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of a secret replaced by ``mark``; spans that overlap become one.

    All rows and columns stay, other columns as they are, whatever their names.  A null text stays
    null, an empty one empty, long ones are masked whole; repeated rows are masked alike.  An empty
    table stays empty.
    """
    rows, spans = find_secrets(docs, params, key, text)
    upto = Window.partitionBy("row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.col("start") > F.max("end").over(upto), F.lit(True))
    runs = spans.withColumn("first", first).withColumn(
        "run", F.sum(F.col("first").cast("int")).over(Window.partitionBy("row").orderBy("start", "kind")))
    merged = runs.groupBy("row", "run").agg(F.min("start").alias("s"), F.max("end").alias("e"))
    merged = merged.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("_quaero_spans"))
    # Equal texts have equal spans: one row for each id and text.
    merged = rows.join(merged, "row").groupBy(F.col("id").alias("_quaero_id"), F.col("digest").alias("_quaero_digest")).agg(
        F.min_by("_quaero_spans", "row").alias("_quaero_spans"))
    names = docs.columns
    joined = docs.withColumn("_quaero_text", F.col(text)).join(
        merged, (F.col(key).eqNullSafe(F.col("_quaero_id"))) & (F.md5(F.col(text)) == F.col("_quaero_digest")), "left")
    parts = F.expr("""transform(sequence(0, size(_quaero_spans)), i -> substring(_quaero_text,
        cast(if(i = 0, 0, _quaero_spans[i - 1].e) + 1 as int),
        cast(if(i = size(_quaero_spans), length(_quaero_text), _quaero_spans[i].s) - if(i = 0, 0, _quaero_spans[i - 1].e) as int)))""")
    clean = F.when(F.col("_quaero_spans").isNull(), F.col("_quaero_text")).otherwise(F.array_join(parts, mark))
    return joined.withColumn(text, clean).select(*names)
