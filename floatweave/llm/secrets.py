"""Secret scans: known patterns, and a randomness test battery for the rest.

Everything here is a DataFrame expression. The base kinds are regular
expressions; positions follow from the lengths of the pieces between matches.

The battery looks at runs of token characters of ``min_length`` and more, words
among them, and at their pieces between separators (a key in a path, say): what
it finds is joined where it overlaps. The alphabet tells the encoding (hex,
base32, base36, letters, base62, base64 or its form for addresses, each case by
itself); runs of digits alone are numbers, not keys. Three tests are made on the
symbols' numbers: chi-squared uniformity over the alphabet, runs above and below
the alphabet's middle, and lag-one serial correlation. Fisher's method combines
them; a token whose combined probability is under ``alpha`` is not random. For
one that passes, its chi-squared value is compared with the one ordinary text of
that length would have (index of coincidence ``TEXT_IC``, or ``HEX_IC`` of the
letters a to f alone), which gives the probability that such text looks so
uniform; longer tokens get far smaller values, and words hardly ever a small
one. For each encoding and band of length a Benjamini-Hochberg threshold over
all tokens of the corpus, from counts in bins, keeps the share of false
discoveries at ``fdr``.

Cases: a null or empty text has no spans; null ids are kept; repeated rows each
get their row; extra columns are ignored; an empty table gives an empty result.
Matches' places are summed in runs and every statistic takes one look at a
token, so very long texts and tokens cost in proportion to their length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

#: The base kinds, in the order that breaks ties.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # a run fails as a whole if it is short, so the length can stand in the pattern
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")

TEXT_IC, TEXT_SKEW = 0.065, 0.0012  # of letters in ordinary text: sum of squared shares; sum of cubes less its square
HEX_IC, HEX_SKEW = 0.26, 0.0174  # the same of the letters a to f among themselves
ALPHABETS = {
    "hex": "0123456789abcdef",
    "hex_upper": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base36_upper": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "letters": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "url_lower": "abcdefghijklmnopqrstuvwxyz0123456789-_",
    "url_upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789-_",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}


def _places(rows: Column, first: Column) -> Column:
    """array<struct<start,end,match,value>> of ``rows`` (gap before each match, match, value), from ``first`` on."""
    none = F.array().cast(_FOUND)

    def step(acc: Column, r: Column) -> Column:
        start = acc["at"] + F.length(r["gap"])
        end = start + F.length(r["match"])
        one = F.array(F.struct(start.alias("start"), end.alias("end"), r["match"].alias("match"), r["value"].alias("value")))
        # after the last gap there is no match
        return F.when(r["match"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.concat(acc["found"], one).alias("found")))

    return F.aggregate(rows, F.struct(first.alias("at"), none.alias("found")), step, lambda acc: acc["found"])


_FOUND = "array<struct<start:int,end:int,match:string,value:string>>"
_RUN = 64  # matches whose places are summed up one by one


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start,end,match,value>> of the leftmost non-overlapping matches; value is
    group 2 where the pattern has one. Code points, end exclusive."""
    groups = 2 if pattern == ASSIGN else 0
    p = F.lit(pattern)
    rows = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, p, F.lit(0)).alias("match"), F.regexp_extract_all(text, p, F.lit(groups)).alias("value"))

    def in_runs(all_rows: Column) -> Column:
        # an array that grows match by match costs the square of their number: so each run has its own,
        # and starts where the lengths of those before it end
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_rows) - 1) / _RUN).cast("int")), lambda k: F.slice(all_rows, k * _RUN + 1, F.lit(_RUN)))
        long = lambda run: F.aggregate(run, F.lit(0), lambda s, r: s + F.length(r["gap"]) + F.coalesce(F.length(r["match"]), F.lit(0)))
        first = F.aggregate(F.transform(runs, long), F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
        return F.flatten(F.transform(F.arrays_zip(runs.alias("run"), F.slice(first, F.lit(1), F.size(runs)).alias("first")), lambda z: _places(z["run"], z["first"])))

    # as the one element of an array, the rows are made once
    found = F.transform(F.array(rows), in_runs)[0]
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(_FOUND))


def _tests(tokens: DataFrame) -> DataFrame:
    """Add encoding, n, the three statistics as z values, p_random, in which they are combined,
    and log_p, of ordinary text being so uniform."""
    t = F.col("token")
    digit, upper, lower = t.rlike("[0-9]"), t.rlike("[A-Z]"), t.rlike("[a-z]")
    mixed = digit & (upper | lower)
    encoding = (
        F.when(t.rlike("^[0-9a-f]+$") & mixed, "hex")
        .when(t.rlike("^[0-9A-F]+$") & mixed, "hex_upper")
        .when(t.rlike("^[A-Z2-7]+$") & mixed, "base32")
        .when(t.rlike("^[0-9a-z]+$") & mixed, "base36")
        .when(t.rlike("^[0-9A-Z]+$") & mixed, "base36_upper")
        .when(t.rlike("^[a-z]+$"), "lower")
        .when(t.rlike("^[A-Z]+$"), "upper")
        .when(t.rlike("^[A-Za-z]+$"), "letters")
        .when(t.rlike("^[0-9A-Za-z]+$") & mixed, "base62")
        .when(t.rlike("^[a-z0-9_-]+$") & mixed, "url_lower")
        .when(t.rlike("^[A-Z0-9_-]+$") & mixed, "url_upper")
        .when(t.rlike("^[A-Za-z0-9+/]+$") & (upper | lower), "base64")
        .when(t.rlike("^[A-Za-z0-9_-]+$") & (upper | lower), "base64url")
    )
    alphabet = F.create_map(*(F.lit(v) for kv in ALPHABETS.items() for v in kv))
    known = tokens.withColumn("encoding", encoding).filter("encoding is not null").withColumn("alphabet", alphabet[F.col("encoding")])
    known = known.withColumn("k", F.length("alphabet").cast("double")).withColumn("n", F.length("token").cast("double"))
    known = known.withColumn("squares", F.expr("aggregate(split(alphabet, ''), 0D, (s, c) -> s + pow(length(token) - length(replace(token, c, '')), 2))"))
    # numbers of the symbols, and for each place its neighbour
    known = known.withColumn("x", F.expr("transform(split(token, ''), c -> cast(instr(alphabet, c) - 1 as double))"))
    known = known.withColumn("mean", F.expr("aggregate(x, 0D, (s, v) -> s + v) / n")).withColumn("high", F.expr("transform(x, v -> 2 * v >= k)"))
    known = known.withColumn("n1", F.expr("cast(size(filter(high, h -> h)) as double)")).withColumn("runs", F.expr("1 + size(filter(sequence(1, size(high) - 1), i -> high[i] <> high[i - 1]))"))
    known = known.withColumn("lag", F.expr("aggregate(sequence(1, size(x) - 1), 0D, (s, i) -> s + (x[i] - mean) * (x[i - 1] - mean))")).withColumn("var", F.expr("aggregate(x, 0D, (s, v) -> s + (v - mean) * (v - mean))"))
    chi = F.expr("k * squares / n - n")
    expected_runs, spread = F.expr("2 * n1 * (n - n1) / n + 1"), F.expr("2 * n1 * (n - n1) * (2 * n1 * (n - n1) - n) / (n * n * (n - 1))")
    known = known.withColumn("chi", chi)
    ic, skew = f"if(k = 16, {HEX_IC}D, {TEXT_IC}D)", f"if(k = 16, {HEX_SKEW}D, {TEXT_SKEW}D)"
    text_mean, text_var = F.expr(f"k * ((n - 1) * {ic} + 1) - n"), F.expr(f"2 * (k - 1) + 4 * n * k * k * {skew}")
    known = known.withColumns(
        {
            "z_uniform": (F.col("chi") - (F.col("k") - 1)) / F.sqrt(2 * (F.col("k") - 1) * (1 - 1 / F.col("n"))),
            # a token on one side of the alphabet, or of one symbol, is not random
            "z_runs": F.coalesce(F.when(spread > 0, (F.col("runs") - expected_runs) / F.sqrt(spread)), F.lit(99.0)),
            "z_serial": F.coalesce(F.when(F.col("var") > 0, F.col("lag") / F.col("var") * F.sqrt("n")), F.lit(99.0)),
            "log_p": _normal_tail((F.col("chi") - text_mean) / F.sqrt(text_var)),
        }
    )
    one_sided = _normal_tail(-F.col("z_uniform"))
    two_sided = lambda z: F.greatest(F.lit(0.0), _normal_tail(-F.abs(z)) - F.log10(F.lit(2.0)))
    # Fisher's sum has six degrees of freedom, whose tail is a closed form
    fisher = (one_sided + two_sided(F.col("z_runs")) + two_sided(F.col("z_serial"))) * F.log(F.lit(10.0))
    p_random = F.exp(-fisher) * (1 + fisher + fisher * fisher / 2)
    return known.select(*tokens.columns, "encoding", "n", "z_uniform", "z_runs", "z_serial", p_random.alias("p_random"), "log_p")


def _normal_tail(z: Column) -> Column:
    """-log10 of the normal probability below ``z`` (0 above the mean)."""
    a = -z
    # far out Mills' ratio by the tail's continued fraction; nearer a polynomial (fixed values, Abramowitz and Stegun 7.1.26)
    t = 1 / (1 + 0.3275911 * a / 2**0.5)
    near = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) / 2
    far = 0.3989422804 * a / (a * a + 1 - 2 / (a * a + 5))
    return F.when(a > 0, (a * a / 2) / F.log(F.lit(10.0)) - F.log10(F.when(a > 2, far).otherwise(near))).otherwise(F.lit(0.0))


def random_tokens(tokens: DataFrame, alpha: float = 1e-3, fdr: float = 0.01) -> DataFrame:
    """Of rows with a column token, those that the battery calls random."""
    tested = stash(_tests(tokens), "tested-tokens")
    tested = tested.withColumn("band", F.least(F.lit(12), F.floor(F.col("n") / 8))).withColumn("bin", F.floor(F.least(F.lit(40.0), F.col("log_p")) * 8))
    passed = tested.withColumn("passed", F.col("p_random") >= alpha)
    # per encoding and band: the fewest -log10(p) such that p times all tokens is at most fdr times those at or beyond it
    counts = passed.groupBy("encoding", "band", "bin").agg(F.count("*").alias("all"), F.count(F.when(F.col("passed"), 1)).alias("good"))
    whole = Window.partitionBy("encoding", "band")
    down = whole.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    level = counts.withColumn("found", F.sum("good").over(down)).withColumn("m", F.sum("all").over(whole))
    level = level.filter(F.pow(F.lit(10.0), -F.col("bin") / 8) * F.col("m") <= fdr * F.col("found")).groupBy("encoding", "band").agg(F.min("bin").alias("least"))
    limits = {f"{r['encoding']} {r['band']}": r["least"] for r in level.collect()}  # one for each encoding and band at most
    least = F.create_map(*(F.lit(v) for kv in limits.items() for v in kv))[F.concat_ws(" ", "encoding", "band")] if limits else F.lit(None).cast("long")
    return passed.filter(F.col("passed") & (F.col("bin") >= least)).select(*tokens.columns, "encoding")


def _united(spans: Column) -> Column:
    """Sorted ``spans`` of one kind, overlapping ones as one."""

    def step(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        both = F.struct(last["start"].alias("start"), s["rank"].alias("rank"), F.greatest(last["end"], s["end"]).alias("end"), s["kind"].alias("kind"))
        before = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(F.coalesce(s["start"] < last["end"], F.lit(False)), F.concat(before, F.array(both))).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(spans, F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>"), step)


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), min_length: int = 12, fdr: float = 0.01) -> DataFrame:
    """(doc_id, *keep, base, added) of each row of ``docs``: arrays of (start, rank, end, kind),
    sorted; ``added`` holds what the battery finds beyond the base spans. ``keep`` must not name
    these columns."""
    if clash := {"doc_id", "base", "added"} & {c.lower() for c in keep}:
        raise ValueError(f"kept columns clash with the result's: {sorted(clash)}")
    text = F.coalesce(F.col("secret_text"), F.lit(""))
    kept = [F.col(f"`{c}`").alias(f"kept_{k}") for k, c in enumerate(keep)]
    src = docs.select(F.col(id_col).cast("long").alias("secret_id"), F.col(text_col).alias("secret_text"), *kept)
    kept = [f"kept_{k}" for k in range(len(keep))]

    def spans(kind: str, found: Column, good) -> Column:
        rank = KINDS.index(kind)
        return F.transform(F.filter(found, good), lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind")))

    base = F.concat(
        spans("assign", matches(text, ASSIGN), lambda m: F.length(m["value"]) >= 8),
        spans("access", matches(text, ACCESS), lambda m: F.lit(True)),
        spans("hex", matches(text, HEX), lambda m: F.lit(True)),
    )
    # runs of token characters, and the pieces of those that hold separators of a kind
    whole = matches(text, f"[A-Za-z0-9+/_-]{{{min_length},}}")
    parts = F.concat(*(F.when(text.rlike(f"[A-Za-z0-9{own}][{cut}]"), matches(text, f"[A-Za-z0-9{own}]{{{min_length},}}")).otherwise(F.array().cast(_FOUND)) for own, cut in (("_-", "+/"), ("+/", "_-"), ("", "+/_-"))))
    tokens = F.transform(F.array_distinct(F.concat(whole, parts)), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["match"].alias("token")))
    rows = src.select("secret_id", *kept, F.array_sort(base).alias("base"), tokens.alias("tokens"))
    rows = stash(rows.withColumn("secret_row", F.monotonically_increasing_id()), "secret-rows")
    one = rows.select("secret_row", "base", F.explode("tokens").alias("t")).select("secret_row", "base", F.col("t.start").alias("start"), F.col("t.end").alias("end"), F.col("t.token").alias("token"))
    one = one.filter(~F.exists("base", lambda b: (b["start"] <= F.col("start")) & (b["end"] >= F.col("end")))).drop("base")
    found = random_tokens(one, fdr=fdr).groupBy("secret_row").agg(
        _united(F.array_sort(F.collect_list(F.struct("start", F.lit(KINDS.index("random")).alias("rank"), "end", F.lit("random").alias("kind"))))).alias("added")
    )
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    joined = rows.drop("tokens").join(found, "secret_row", "left")
    return joined.select(F.col("secret_id").alias("doc_id"), *(F.col(k).alias(c) for k, c in zip(kept, keep)), "base", F.coalesce("added", none).alias("added"))


def span_text(spans: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with each of the sorted ``spans`` replaced by ``mark``; overlapping ones are replaced together."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, s: Column) -> Column:
        part = F.concat(text.substr(acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        parts = F.when(s["start"] >= acc["at"], F.concat(acc["parts"], F.array(part))).otherwise(acc["parts"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), parts.alias("parts"))

    done = F.aggregate(spans, start, step, lambda acc: F.concat(F.array_join(acc["parts"], ""), text.substr(acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)
