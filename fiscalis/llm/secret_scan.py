"""Secret scan: fixed patterns and a battery of randomness tests, in Spark functions only.

Spans are found by marking matches with a separator and splitting the text at
it; the lengths of the pieces give positions in code points. Next to the three
fixed kinds, every run of 16 or more characters of the usual encodings is a
candidate of kind `random`. A run with signs of base64 (+ /) and of base64url (_ -) is in
neither encoding as a whole; there the runs of 16 or more characters of each of the two are the
candidates, and both may be found where they overlap. The encoding is inferred from its characters (hex,
base32, one-case letters with digits, base64), and three tests measure how far
it is from a uniform random string of that alphabet: chi-squared of the symbol
counts, Wald-Wolfowitz runs above and below the middle symbol, and lag-one serial
correlation. The sum of their squared z-scores is its departure.

The null hypothesis is "a word of a language". Words of letters in one case and of
the same length class give the null distribution of the departure over all
documents; where they are fewer than `LEAST_NULL`, shorter classes join them
(shorter words look more random, so this errs towards fewer findings). A
candidate's p-value is the share of null words that depart as little.
Benjamini-Hochberg over all candidates of a length class then picks the largest
departure that keeps the expected share of false findings below `FALSE_SHARE`.
Only counts per length class and departure bin are shuffled: a fixed number of groups.

Results for odd input: NULL and empty texts have no spans; rows are judged one by
one, so repeated rows and ids and NULL ids need no care; without candidates or
without null words no random span is reported (there is no evidence).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fiscalis.session import cut

# Fixed patterns of the base kinds, and the least length of what they must hold.
ASSIGN = (r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
          r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_VALUE = 12
# A longer match can't begin inside a shorter one for these two, so the least length is part of the pattern.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
CANDIDATE = r"[A-Za-z0-9+/_-]{16,}"
BASE64, BASE64URL = r"[A-Za-z0-9+/]{16,}", r"[A-Za-z0-9_-]{16,}"
WORD = "^([A-Z]?[a-z]+|[A-Z]+)$"

DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MARK, INSTEAD = "", ""
GROUP = 256

LENGTH_CLASSES = [16, 20, 24, 32, 48]  # least length of each
BINS_A_UNIT, LAST_BIN = 4, 400
FALSE_SHARE = 0.05
LEAST_NULL = 200

SPANS = "array<struct<start:int,stop:int,piece:string>>"


def _let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as (start, stop, piece), in code points.

    Pieces are summed up in groups, so that a text with very many matches takes
    neither quadratic time nor memory.
    """
    def of_group(group: Column, at: Column) -> Column:
        start = F.struct(at.alias("at"), F.expr(f"cast(array() AS {SPANS})").alias("spans"))

        def add(acc: Column, piece: Column) -> Column:
            end = acc["at"] + F.char_length(piece["text"])
            span = F.array(F.struct(acc["at"].alias("start"), end.alias("stop"), piece["text"].alias("piece")))
            return F.struct(end.alias("at"), F.when(piece["odd"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))
        return F.aggregate(group, start, add, lambda acc: acc["spans"])

    def of_pieces(pieces: Column) -> Column:
        numbered = F.transform(pieces, lambda p, i: F.struct(p.alias("text"), (i % 2 == 1).alias("odd")))
        return _let(numbered, lambda all_: _let(F.transform(
            F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / GROUP).cast("int")), lambda g: F.slice(all_, g * GROUP + 1, F.lit(GROUP))), with_starts))

    def with_starts(groups: Column) -> Column:
        sizes = F.transform(groups, lambda g: F.aggregate(g, F.lit(0), lambda n, p: n + F.char_length(p["text"])))
        starts = F.aggregate(sizes, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
        return F.flatten(F.zip_with(groups, _let(starts, lambda all_: F.slice(all_, 1, F.size(groups))), of_group))

    marked = F.regexp_replace(text, pattern, f"{MARK}$0{MARK}")
    return _let(F.split(marked, MARK, -1), lambda pieces: F.when(F.size(pieces) > 1, of_pieces(pieces)).otherwise(F.expr(f"cast(array() AS {SPANS})")))


def _alphabet(token: Column) -> Column:
    """The symbols of the encoding a token seems to be in; NULL where it is a plain word."""
    return (F.when(token.rlike(WORD), F.lit(None))
            .when(token.rlike("^[0-9a-f]+$"), DIGITS + LOWER[:6])
            .when(token.rlike("^[0-9A-F]+$"), DIGITS + UPPER[:6])
            .when(token.rlike("^[A-Z2-7]+$"), UPPER + DIGITS[2:8])
            .when(token.rlike("^[a-z0-9]+$"), DIGITS + LOWER)
            .when(token.rlike("^[A-Z0-9]+$"), DIGITS + UPPER)
            .when(token.rlike("^[A-Za-z0-9]+$"), DIGITS + UPPER + LOWER)
            .when(token.rlike("^[A-Za-z0-9_-]+$"), UPPER + LOWER + DIGITS + "-_")
            .when(token.rlike("^[A-Za-z0-9+/]+$"), UPPER + LOWER + DIGITS + "+/"))


def departure(token: Column, alphabet: Column) -> Column:
    """Sum of squared z-scores of the three tests; 3 is typical of random strings."""
    def runs_and_symbols(x: Column) -> Column:
        t, n, size, v = x["t"], x["n"], x["size"], x["v"]
        chars = F.filter(F.split(t, ""), lambda c: c != "")
        squares = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda s, c: s + F.pow(n - F.char_length(F.replace(t, c, F.lit(""))), F.lit(2)))
        uniform = F.greatest(F.lit(0.0), (size / n * squares - n - (size - 1)) / F.sqrt(2 * (size - 1) * (n - 1) / n))
        high = F.aggregate(v, F.lit(0.0), lambda s, y: s + F.when(y >= size / 2, 1.0).otherwise(0.0))
        runs = F.aggregate(pairs(v, lambda y, z: F.when((y >= size / 2) != (z >= size / 2), 1.0).otherwise(0.0)), F.lit(1.0), lambda s, y: s + y)
        mean = F.aggregate(v, F.lit(0.0), lambda s, y: s + y) / n
        return _let(F.struct(uniform.alias("uniform"), high.alias("high"), runs.alias("runs"), n.alias("n"),
                             _let(mean, lambda m: F.transform(v, lambda y: y - m)).alias("v")), combined)

    def pairs(v: Column, of) -> Column:
        return F.zip_with(F.slice(v, 2, F.size(v) - 1), F.slice(v, 1, F.size(v) - 1), of)

    def combined(x: Column) -> Column:
        n, high, v = x["n"], x["high"], x["v"]
        expected = 2 * high * (n - high) / n + 1
        spread = (expected - 1) * (expected - 2) / (n - 1)
        run = F.when(spread > 0, (x["runs"] - expected) / F.sqrt(F.when(spread > 0, spread))).otherwise(F.sqrt(n))
        square = F.aggregate(v, F.lit(0.0), lambda s, y: s + y * y)
        lagged = F.aggregate(pairs(v, lambda y, z: y * z), F.lit(0.0), lambda s, y: s + y)
        sums = _let(F.struct(square.alias("square"), lagged.alias("lagged")), lambda s: F.when(
            s["square"] > 0, (s["lagged"] / F.when(s["square"] > 0, s["square"]) + 1 / n) * F.sqrt(n)).otherwise(F.sqrt(n)))
        return x["uniform"] * x["uniform"] + run * run + sums * sums

    values = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: (F.instr(alphabet, c) - 1).cast("double"))
    return _let(F.struct(token.alias("t"), F.char_length(token).cast("double").alias("n"),
                         F.char_length(alphabet).cast("double").alias("size"), values.alias("v")), runs_and_symbols)


def _length_class(n: Column) -> Column:
    out = F.lit(0)
    for i, least in enumerate(LENGTH_CLASSES):
        out = F.when(n >= least, i).otherwise(out)
    return out


def _candidates(text: Column) -> Column:
    """Spans of one encoding each: runs of candidate characters, in parts where they mix the signs of two encodings."""
    def parts(run: Column, pattern: str) -> Column:
        return F.transform(matches(run["piece"], pattern), lambda p: F.struct(
            (run["start"] + p["start"]).alias("start"), (run["start"] + p["stop"]).alias("stop"), p["piece"].alias("piece")))
    return F.flatten(F.transform(matches(text, CANDIDATE), lambda run: F.when(
        run["piece"].rlike("[+/]") & run["piece"].rlike("[_-]"), F.concat(parts(run, BASE64), parts(run, BASE64URL))).otherwise(F.array(run))))


def _scan(docs: DataFrame, text: str) -> DataFrame:
    """Adds the span arrays of each kind to `docs`, under `_scan`."""
    clean = F.translate(F.coalesce(F.col(text), F.lit("")), MARK, INSTEAD)

    def bare(spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"], s["stop"]))
    assign = F.filter(matches(clean, ASSIGN), lambda s: F.char_length(F.regexp_extract(s["piece"], ASSIGN, 2)) >= ASSIGN_VALUE)

    def tested(s: Column) -> Column:
        return _let(F.struct(s["start"], s["stop"], s["piece"], _alphabet(s["piece"]).alias("alphabet")), lambda x: F.struct(
            x["start"], x["stop"], s["piece"].rlike(WORD).alias("word"), _length_class(x["stop"] - x["start"]).alias("length"),
            F.least(F.lit(LAST_BIN).cast("long"), F.floor(BINS_A_UNIT * F.when(x["alphabet"].isNull(), departure(F.lower(x["piece"]), F.lit(LOWER)))
                                             .otherwise(departure(x["piece"], F.coalesce(x["alphabet"], F.lit("ab")))))).cast("int").alias("bin")))
    return docs.withColumn("_scan", F.struct(
        bare(assign).alias("assign"), bare(matches(clean, ACCESS)).alias("access"), bare(matches(clean, HEX)).alias("hex"),
        F.transform(_candidates(clean), tested).alias("tested")))


def _last_bins(scanned: DataFrame, false_share: float) -> list[int]:
    """For each length class, the largest departure bin that counts as found; -1 for none."""
    rows = scanned.select(F.inline("_scan.tested")).groupBy("word", "length", "bin").count().collect()
    out = []
    for k in range(len(LENGTH_CLASSES)):
        null = [0] * (LAST_BIN + 1)
        found = [0] * (LAST_BIN + 1)
        for length in range(k, -1, -1):
            if sum(null) < LEAST_NULL:
                for r in rows:
                    if r["word"] and r["length"] == length:
                        null[r["bin"]] += r["count"]
        for r in rows:
            if not r["word"] and r["length"] == k:
                found[r["bin"]] += r["count"]
        last, below, picked = -1, 0, 0
        for b in range(LAST_BIN + 1):
            below, picked = below + null[b], picked + found[b]
            p = (1 + below) / (1 + sum(null))
            if picked and p * sum(found) <= false_share * picked:
                last = b
        out.append(last)
    return out


def find_secrets(docs: DataFrame, text: str = "text", false_share: float = FALSE_SHARE) -> DataFrame:
    """`docs` with `secret_spans`: (start, kind, stop) of every finding, sorted by start and kind
    in the order assign, access, hex, random. Random spans inside or across a base span are left out."""
    scanned = cut(docs.sparkSession, _scan(docs, text), "secret-scan")
    last = F.array(*map(F.lit, _last_bins(scanned, false_share)))
    def ranked(rank: int, kind: str) -> Column:
        return F.transform(F.col(f"_scan.{kind}"), lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["stop"].alias("stop")))
    base = F.flatten(F.array(*[ranked(i, kind) for i, kind in enumerate(("assign", "access", "hex"))]))
    added = F.transform(
        F.filter("_scan.tested", lambda s: ~s["word"] & (s["bin"] <= F.element_at(last, s["length"] + 1))
                 & ~F.exists(F.col("_base"), lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"]))),
        lambda s: F.struct(s["start"].alias("start"), F.lit(3).alias("rank"), s["stop"].alias("stop")))
    kinds = F.array(*map(F.lit, ("assign", "access", "hex", "random")))
    spans = F.transform(F.array_sort(F.concat("_base", added)), lambda s: F.struct(
        s["start"].alias("start"), F.element_at(kinds, s["rank"] + 1).alias("kind"), s["stop"].alias("stop")))
    return scanned.withColumn("_base", base).withColumn("secret_spans", spans).drop("_base", "_scan")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def secret_digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    base = F.filter("secret_spans", lambda s: s["kind"] != "random")

    def n(kind: str) -> Column:
        return F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(key, n("assign"), n("access"), n("hex"), F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
                        _joined(F.col("secret_spans")).alias("spans"), n("random"))


def redact(found: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """Texts with each finding (overlapping ones together) replaced by `mark`; `secret_spans` goes."""
    start = F.expr("cast(array() AS array<struct<start:int,stop:int>>)")

    def add(acc: Column, s: Column) -> Column:
        end = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(end["start"].alias("start"), F.greatest(end["stop"], s["stop"]).alias("stop"))))
        return F.when((F.size(acc) > 0) & (s["start"] < F.try_element_at(acc, F.lit(-1))["stop"]), joined).otherwise(
            F.concat(acc, F.array(F.struct(s["start"].alias("start"), s["stop"].alias("stop")))))
    merged = F.aggregate("secret_spans", start, add)
    body = F.col(text)
    pieces = _let(merged, lambda spans: F.zip_with(
        F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["stop"])),
        F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.char_length(body))), lambda a, b: F.substring(body, a + 1, b - a)))
    return found.withColumn(text, F.when(F.size("secret_spans") > 0, F.array_join(pieces, mark)).otherwise(body)).drop("secret_spans")
