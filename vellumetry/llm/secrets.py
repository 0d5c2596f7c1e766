"""Secret scans: base patterns, and a randomness test battery over long tokens. Native functions only.

Base spans come from three patterns. The method looks at further tokens: runs of ``[A-Za-z0-9+/_-]`` of
at least LEAST characters and the runs of letters and digits inside them; numbers are left out, and a run
that is hexadecimal but for ``-`` and ``_`` is tested without these. The encoding is inferred from a
token's characters (hex, base32, base36, base64), which fixes the alphabet that a random token would use
evenly. Three tests ask whether the token could be such a random string:

* chi-squared of the alphabet's uniformity,
* runs above and below the alphabet's middle (Wald-Wolfowitz),
* serial correlation of neighbouring symbols.

Their p-values are combined by Fisher's rule into ``s``, minus log10 of the combined p: small for random
tokens, large for ordinary ones, and the larger the longer an ordinary token is. Short tokens are told apart
less well by these, so a second serial statistic is added, ``b``: how much oftener the corpus has the token's
pairs of neighbouring letters than chance would, as a mean log ratio in which a change between letter and digit
counts as rare. The score is log(s) + PAIRS * b.

What is controlled is the share of ordinary tokens among those reported. The null hypothesis is thus the
ordinary token: how the score is spread, by class of length and by whether a token mixes cases, over words of
the corpus glued together. All letters of every distinct text are cut into such runs, and as a run ends with the
letter that the next begins with, every pair of neighbouring letters is counted once, over the same runs. PRIOR
runs of fixed values are added, which alone serve a corpus without prose. A token's p-value is the share of ordinary runs that score as low; s below FLOOR counts as
FLOOR, where the fit holds. In each class of length the Benjamini-Hochberg rule at RATE then gives the tokens
reported, as spans of kind ``random``. The ranks that the rule needs come from counts of p-values in bins, so
no list of tokens is gathered, and as only the classes' limits are sent to the rows, no token is joined by
its value.

Spans are ``kind:start:end`` in code points, end exclusive. Spans of kind random overlap neither base
spans nor each other. Defined results: null text counts as empty; text without spans has counts 0 and the
hash of the empty string; repeated rows get their row each; an empty table gives an empty result; very long
texts and very many matches are processed whole, positions being summed in blocks. Of the other columns,
``digest`` ignores all but doc_id and ``redact`` passes all on, whatever their names; a doc_id may be null
or repeated.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, quoted

#: The base patterns, and what a match needs beside.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24

#: Tokens for the battery: at least so many of these characters.
LEAST = 20
TOKEN, PIECE = f"[A-Za-z0-9+/_-]{{{LEAST},}}", f"[A-Za-z0-9]{{{LEAST},}}"
#: Whether there is such a token, looked for at the beginnings of runs only.
LONG = f"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{LEAST}}}"
#: False-discovery rate, bins of -log10 p, the least s that counts, and runs that the fixed values stand for.
RATE, BINS, FLOOR, PRIOR = 0.05, 400, 0.5, 50
#: Weight of the pairs of letters, pairs that stand for chance in each mean, counts that stand for it in the corpus,
#: and the log ratio of a change between letter and digit, which words do not have.
PAIRS, BLANK, SMOOTH, CHANGE = 2.0, 4, 26.0, -2.0
#: Class of length (its lower end), mean and spread of the score, measured on about 1,300 glued runs
#: of each class from 10,000 documents of prose, and rounded.
ORDINARY = ((20, 2.8, 0.97), (24, 3.2, 0.9), (28, 3.5, 0.84), (32, 3.8, 0.74), (40, 4.2, 0.73), (64, 5.0, 0.66), (128, 6.0, 0.55))
#: Runs that a block of glued letters is cut into: each class of length, in lower case and in mixed.
RUNS = [(low, camel) for camel in (False, True) for low, _, _ in ORDINARY]
BLOCK = sum(low - 1 for low, _ in RUNS)
#: Alphabets of the encodings, in lower case where case does not matter; ``-`` and ``_`` are other signs for ``+`` and ``/``.
ALPHABETS = {"hex": "0123456789abcdef", "base32": "abcdefghijklmnopqrstuvwxyz234567", "base36": "0123456789abcdefghijklmnopqrstuvwxyz", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}
#: All of their symbols, the codes they have, and the signs that tables of pairs have a row for: none of these, letters
#: in either case, digits.
SYMBOLS = ALPHABETS["base64"] + "-_"
CODES = range(min(map(ord, SYMBOLS)), max(map(ord, SYMBOLS)) + 1)
ROWS = "abcdefghijklmnopqrstuvwxyz0"
#: Matches of one text whose positions are summed one after the other; beyond that in blocks of so many.
ROW = 64
KINDS = ("assign", "access", "hex", "random")
SPAN = "array<struct<start:long,kind:int,end:long>>"


def _let(value: Column, body) -> Column:
    """body(value) with value computed once: inside a lambda an expression would be computed for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _positions(text: Column, pattern: str, kind: int, keep) -> Column:
    """Spans of the leftmost non-overlapping matches; keep(i) says which, i counted from 0.

    The texts between matches come from split, the matches from regexp_extract_all; their lengths add
    up to the positions, block by block where there are many."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    zipped = F.zip_with(between, found, lambda a, m: F.struct(F.length(a).cast("long").alias("a"), F.length(m).cast("long").alias("m")))

    def summed(pairs: Column, begin: Column) -> Column:
        zero = F.struct(begin.alias("at"), F.array().cast(SPAN).alias("out"))

        def step(s: Column, x: Column) -> Column:
            start = s["at"] + x["a"]
            end = start + F.coalesce(x["m"], F.lit(0))
            span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
            return F.struct(end.alias("at"), F.when(x["m"].isNotNull(), F.concat(s["out"], F.array(span))).otherwise(s["out"]).alias("out"))

        return F.aggregate(pairs, zero, step, lambda s: s["out"])

    def length(pairs: Column) -> Column:
        return F.aggregate(pairs, F.lit(0).cast("long"), lambda s, x: s + x["a"] + F.coalesce(x["m"], F.lit(0)))

    def many(z: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), (F.size(z) / ROW).cast("int")), lambda i: F.slice(z, i * ROW + 1, ROW))
        return _let(blocks, lambda b: _let(F.transform(b, length), lambda n: F.flatten(F.transform(b, lambda x, i: summed(x, F.aggregate(F.slice(n, 1, i), F.lit(0).cast("long"), lambda s, y: s + y))))))

    spans = _let(zipped, lambda z: F.when(F.size(z) <= ROW, summed(z, F.lit(0).cast("long"))).otherwise(many(z)))
    return F.filter(spans, keep) if keep is not None else spans


def _base(text: Column, long: Column) -> Column:
    """All base spans, sorted by start, then kind; long says whether the text has a token of LEAST characters, as
    every match of the kinds access and hex is."""
    none = F.array().cast(SPAN)
    cue = _let(F.lower(text), lambda low: low.contains("passw") | low.contains("secret") | low.contains("token") | low.contains("apikey") | low.contains("api_key"))
    # A match is dropped by the length of its value, which is the match's tail.
    value = F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(1)), lambda v: F.length(v))
    assign = _let(value, lambda v: F.filter(_positions(text, ASSIGN, 0, None), lambda s, i: F.get(v, i) >= ASSIGN_LEAST))
    access = _positions(text, ACCESS, 1, lambda s: s["end"] - s["start"] >= ACCESS_LEAST)
    # A run of hex digits is a whole match, so asking for the length inside the pattern is the same.
    hexes = _positions(text, HEX.replace("+", f"{{{HEX_LEAST},}}"), 2, None)
    return F.array_sort(
        F.concat(
            F.when(cue, assign).otherwise(none),
            F.when(long & text.contains("AKIA"), access).otherwise(none),
            F.when(long & text.rlike(f"[0-9a-f]{{{HEX_LEAST}}}"), hexes).otherwise(none),
        )
    )


def _normal_tail(z: Column) -> Column:
    """P(Z > z), by the formula 26.2.17 of Abramowitz and Stegun (error below 1e-7)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-z * z / 2) / 2.5066282746310002 * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _fixed(values, kind: str) -> Column:
    """A fixed array, to look values up in."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def _place(symbol: str, encoding: str) -> int | None:
    """Twice a symbol's place in its encoding's alphabet, counted from the middle."""
    alphabet = ALPHABETS[encoding]
    at = alphabet.find({"-": "+", "_": "/"}.get(symbol, symbol) if encoding == "base64" else symbol.lower())
    return 2 * at - len(alphabet) + 1 if at >= 0 else None


def _codes(token: Column) -> Column:
    return F.transform(F.split(token, ""), lambda x: F.ascii(x))


def _looked_up(values: Column, row: Column, code: Column) -> Column:
    """The value for a symbol's code in a table with a row for each of several things, as ``_table`` makes it."""
    return F.get(values, row * len(CODES) + code)


def _table(rows: list[list[int]], kind: str) -> Column:
    """Rows of values, one for each of CODES. Plans hold and print fixed values, several times over, and the driver
    keeps what they print: so a table may have a few thousand values, not one for each pair of symbols and encoding."""
    return _fixed([0] * CODES.start + [x for row in rows for x in row], kind)


def _products(codes: Column, which: Column) -> Column:
    """The sum, over each two neighbouring symbols, of four times the product of their places in the alphabet of this
    number. The sum's last seven bits are 64 and the place of the symbol last seen."""
    places = _table([[_place(chr(k), e) or 0 if chr(k) in SYMBOLS else 0 for k in CODES] for e in ALPHABETS], "int")

    def step(s: Column, x: Column) -> Column:
        last = s.bitwiseAND(F.lit(127)) - 64
        return s - last + _looked_up(places, which, x) * (last * 128 + 1)

    return F.shiftright(F.aggregate(codes, F.lit(64).cast("long"), step), 7)


def _ratios(codes: Column, pairs: list[float]) -> Column:
    """The sum, over each two neighbouring symbols, of their log ratio, in millionths. The sum's last five bits are the
    table's row of the symbol last seen; what is looked up there for the next adds the ratio and moves on to its row."""

    def ratio(a: int, b: int) -> int:
        """Of symbols by row; it counts if both are letters, or one a letter and one a digit."""
        if not a or not b or a == b == len(ROWS):
            return 0
        return round(1e6 * (CHANGE if len(ROWS) in (a, b) else pairs[(a - 1) * 26 + b - 1]))

    to = [ROWS.find("0" if chr(k).isdigit() else chr(k).lower()) + 1 for k in CODES]
    steps = _table([[(ratio(row, k) << 5) + k - row for k in to] for row in range(len(ROWS) + 1)], "bigint")
    return F.shiftright(F.aggregate(codes, F.lit(0).cast("long"), lambda s, x: s + _looked_up(steps, s.bitwiseAND(F.lit(31)).cast("int"), x)), 5)


def battery(tokens: DataFrame, pairs: list[float] | None = None) -> DataFrame:
    """Adds encoding, size (of the alphabet), p_uniform, p_runs, p_serial and p (combined) to ``token``; with pairs
    also b, their ``pair_score``."""
    t, n = F.col("token"), F.octet_length("token")
    named = tokens.withColumn(
        "encoding",
        F.when(t.rlike(r"^([0-9a-f]+|[0-9A-F]+)$"), "hex").when(t.rlike(r"^[A-Z2-7]+$"), "base32").when(t.rlike(r"^([0-9a-z]+|[0-9A-Z]+)$"), "base36").otherwise("base64"),
    )

    def by_encoding(made) -> Column:
        out = F
        for e in list(ALPHABETS)[:-1]:
            out = out.when(F.col("encoding") == e, made(e))
        return out.otherwise(made(list(ALPHABETS)[-1]))

    def halves(encoding: str) -> Column:
        """1 for each symbol above the alphabet's middle, 0 for each below it."""
        known = [x for x in SYMBOLS if _place(x, encoding) is not None]
        return F.translate(t, "".join(known), "".join("1" if _place(x, encoding) > 0 else "0" for x in known))

    which = by_encoding(lambda e: F.lit(list(ALPHABETS).index(e)))
    named = named.withColumns({"size": by_encoding(lambda e: F.lit(float(len(ALPHABETS[e])))), "which": which, "halves": by_encoding(halves), "codes": _codes(t)})
    # The sum of squared counts, symbol by symbol: no more of these than the alphabet has.
    sq = F.aggregate(F.array_distinct("codes"), F.lit(0.0), lambda s, x: s + F.pow(n - F.octet_length(F.replace(t, F.char(x), F.lit(""))), F.lit(2.0)))
    named = named.withColumns({"sq": sq, "sum": _products(F.col("codes"), F.col("which")) / 4})
    # Steps up are counted; there is one step down more if the token begins above the middle, one fewer if it ends there.
    up = F.floor((n - F.octet_length(F.replace("halves", F.lit("01"), F.lit("")))) / 2)
    ends = F.startswith("halves", F.lit("1")).cast("int") - F.endswith("halves", F.lit("1")).cast("int")
    named = named.withColumns({"ups": F.octet_length(F.replace("halves", F.lit("0"), F.lit(""))).cast("double"), "runs": 1 + 2 * up + ends})
    if pairs:
        named = named.withColumn("b", _pair_mean(t, F.col("codes"), pairs))
    df, var = F.col("size") - 1, (F.col("size") * F.col("size") - 1) / 12
    n = n.cast("double")
    chi = F.col("sq") * F.col("size") / n - n
    expected = 1 + 2 * F.col("ups") * (n - F.col("ups")) / n
    spread = F.greatest((expected - 1) * (expected - 2) / F.greatest(n - 1, F.lit(1.0)), F.lit(1e-3))
    z = {
        "z_uniform": (F.pow(F.greatest(chi, F.lit(1e-9)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)),
        "z_runs": F.abs(F.col("runs") - expected) / F.sqrt(spread),
        "z_serial": F.abs(F.col("sum") / (var * F.sqrt(F.greatest(n - 1, F.lit(1.0))))),
    }
    named = named.withColumns(z)
    out = named.withColumns({"p_uniform": _normal_tail(F.col("z_uniform")), "p_runs": 2 * _normal_tail(F.col("z_runs")), "p_serial": 2 * _normal_tail(F.col("z_serial"))})
    x = sum(-2 * F.log(F.greatest(F.col(c), F.lit(1e-300))) for c in ("p_uniform", "p_runs", "p_serial"))
    out = out.withColumn("half", x / 2)  # Fisher: chi-squared with six degrees of freedom has a closed tail
    half = F.col("half")
    return out.withColumn("p", F.least(F.exp(-half) * (1 + half + half * half / 2), F.lit(1.0))).drop("which", "halves", "codes", "sq", "ups", "runs", "sum", "half", *z)


def _class_of(length: Column) -> Column:
    return sum(F.when(length >= low, 1).otherwise(0) for low, _, _ in ORDINARY)


def letter_pairs(runs: DataFrame) -> list[float]:
    """log(26 p(second letter | first letter)) of all 26 * 26 pairs, held within -3 and 3, from the pairs of ``token``."""
    low = F.lower("token")
    # Those that begin at odd places, then those at even ones.
    cut = F.concat(*[F.regexp_extract_all(x, F.lit(".."), F.lit(0)) for x in (low, F.substr(low, F.lit(2)))])
    # No more rows than pairs of letters.
    counts = {r["pair"]: r["n"] for r in runs.select(F.explode(cut).alias("pair")).groupBy("pair").agg(F.count("*").alias("n")).collect()}
    letters = "abcdefghijklmnopqrstuvwxyz"
    first = {a: sum(counts.get(a + b, 0) for b in letters) for a in letters}
    return [max(-3.0, min(3.0, math.log((26 * counts.get(a + b, 0) + SMOOTH) / (first[a] + SMOOTH)))) for a in letters for b in letters]


def _pair_mean(token: Column, codes: Column, pairs: list[float]) -> Column:
    """The mean of the pairs' ratios; where all are letters, all pairs count."""
    kinds = F.translate(token, SYMBOLS, "".join("a" if x.isalpha() else "0" if x.isdigit() else "-" for x in SYMBOLS))
    counted = F.when(token.rlike("^[A-Za-z]+$"), F.octet_length(token) - 1).otherwise(F.regexp_count(kinds, F.lit("a(?=[a0])|0(?=a)")))
    return _ratios(codes, pairs) / 1e6 / (counted + BLANK)


def pair_score(token: Column, pairs: list[float]) -> Column:
    """Mean log ratio of the token's pairs of neighbouring letters, and changes between letters and digits, with
    BLANK pairs of ratio 1."""
    return _pair_mean(token, _codes(token), pairs)


def _scored(tokens: DataFrame, pairs: list[float]) -> DataFrame:
    """Adds score, mixed (whether the alphabet has both cases) and class to ``token``."""
    s = F.greatest(-F.log10(F.greatest(F.col("p"), F.lit(1e-300))), F.lit(FLOOR))
    out = battery(tokens, pairs).withColumns({"mixed": F.col("encoding") == "base64", "class": _class_of(F.length("token"))})
    return out.withColumn("score", F.log(s) + PAIRS * F.col("b"))


def _plan(turn: int) -> str:
    """The runs of a block, beginning with the one of this number: places of the first letter and of the next run's."""
    order, out, at = RUNS[turn:] + RUNS[:turn], [], 0
    for low, camel in order:
        out.append(f"named_struct('at', {at}, 'next', {at + low - 1}, 'camel', {camel})")
        at += low - 1
    return f"array({', '.join(out)})"


def glued_runs(docs: DataFrame) -> DataFrame:
    """``token``: the letters of every distinct text, glued together and cut into runs of each class of length, half of
    them in lower case, half with the words' first letters as capitals. Neighbouring runs of a text share a letter.

    No letter is left out: the last run of a text takes what is too short for another, and a text of fewer than
    LEAST letters is one run, of no class."""
    # Other signs go first: in lower case some of them become letters.
    words = F.regexp_replace("text", "[^A-Za-z]+", " ")
    whole = docs.where("text is not null").select(F.replace(F.initcap(words), F.lit(" "), F.lit("")).alias("glued")).where("glued <> ''").distinct()
    # Blocks keep a place in a long text near; each ends with the first letter of the next.
    cut = F.regexp_extract_all("glued", F.lit(f".{{{BLOCK}}}(?=.{{{LEAST}}})|.+"), F.lit(0))
    joined = _let(cut, lambda c: F.transform(c, lambda b, i: F.concat(b, F.coalesce(F.substring(F.get(c, i + 1), 1, 1), F.lit("")))))
    blocks = whole.select(F.explode(joined).alias("block"))
    block, n = F.col("block"), F.octet_length("block")
    plan = F.get(F.expr(f"array({', '.join(map(_plan, range(len(RUNS))))})"), F.pmod(F.xxhash64("block"), F.lit(len(RUNS))).cast("int"))
    kept = F.filter(plan, lambda r: (r["at"] == 0) | (n - r["at"] >= LEAST))

    def made(r: Column) -> Column:
        end = F.when(n - r["next"] >= LEAST, r["next"] + 1).otherwise(n)
        own = F.substring(block, r["at"] + 1, end - r["at"])
        return F.when(r["camel"], own).otherwise(F.lower(own))

    return blocks.select(F.explode(F.transform(kept, made)).alias("token"))


def ordinary(runs: DataFrame, pairs: list[float]) -> DataFrame:
    """(class, mixed, mean, spread) of the score over glued words: a row for each class and each kind of case."""
    seen = _scored(runs.where(F.length("token") >= LEAST), pairs).select("class", "mixed", F.col("score").alias("x"), F.lit(1.0).alias("w"))
    spark = runs.sparkSession
    # The fixed values as PRIOR runs: half of them one spread below the mean, half above.
    fixed = [(k + 1, mixed, m + side * sd, PRIOR / 2) for k, (_, m, sd) in enumerate(ORDINARY) for mixed in (False, True) for side in (-1, 1)]
    every = seen.unionByName(spark.createDataFrame(fixed, "class int, mixed boolean, x double, w double"))
    mean = F.sum(F.col("w") * F.col("x")) / F.sum("w")
    square = F.sum(F.col("w") * F.col("x") * F.col("x")) / F.sum("w")
    return every.groupBy("class", "mixed").agg(mean.alias("mean"), F.sqrt(F.greatest(square - mean * mean, F.lit(0.01))).alias("spread"))


def p_ordinary(tokens: DataFrame, null: DataFrame, pairs: list[float]) -> DataFrame:
    """Adds p0, the share of ordinary runs of its class that score as low as the token, and bin, -10 log10 of it."""
    at = _scored(tokens, pairs).join(F.broadcast(null), ["class", "mixed"])
    p0 = _normal_tail((F.col("mean") - F.col("score")) / F.col("spread"))
    bin_of = F.least(F.floor(-10 * F.log10(F.greatest(p0, F.lit(1e-300)))), F.lit(BINS)).cast("int")
    return at.withColumn("p0", p0).withColumn("bin", bin_of)


def limits(tested: DataFrame) -> DataFrame:
    """(class, cut): tokens of a class whose bin is at least cut are reported; a class may have no cut."""
    counts = tested.groupBy("class", "bin").agg(F.count("*").alias("n"))
    down = Window.partitionBy("class").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    edge = F.pow(F.lit(10.0), -F.col("bin") / 10)
    steps = counts.withColumn("rank", F.sum("n").over(down)).withColumn("m", F.sum("n").over(Window.partitionBy("class")))
    return steps.where(edge <= RATE * F.col("rank") / F.col("m")).groupBy("class").agg(F.min("bin").alias("cut"))


def _candidates(text: Column, long: Column) -> Column:
    """Spans and the strings to test of runs and of the pieces inside them."""
    spans = F.array_distinct(F.concat(_positions(text, TOKEN, 3, None), _positions(text, PIECE, 3, None)))

    def made(s: Column) -> Column:
        own = F.substring(text, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))
        bare = F.translate(own, "-_", "")
        token = F.when(bare.rlike(f"^[0-9a-fA-F]{{{LEAST},}}$"), bare).otherwise(own)
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), token.alias("token"))

    found = F.filter(F.transform(spans, made), lambda t: ~t["token"].rlike("^[0-9+/_-]*$"))
    return F.when(long, found).otherwise(F.array().cast("array<struct<start:long,end:long,token:string>>"))


def scan(docs: DataFrame, keep: list[str], tmp: Scratch) -> DataFrame:
    """``row`` (a struct of the columns named in keep), ``base`` and ``spans`` (arrays of start, kind, end), for
    every row. It reads tables of tmp."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select(F.struct(*[F.col(quoted(c)) for c in keep]).alias("row"), text.alias("text")).withColumn("long", F.col("text").rlike(LONG))
    found = found.select("row", _base(F.col("text"), F.col("long")).alias("base"), _candidates(F.col("text"), F.col("long")).alias("tokens"))
    # Tokens that a base span touches are known already.
    free = F.filter("tokens", lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))  # of stored columns
    found = tmp.write(found.withColumn("tokens", free).withColumn("uid", F.when(F.size("tokens") > 0, F.monotonically_increasing_id())))
    runs = tmp.write(glued_runs(docs))
    pairs = letter_pairs(runs)
    null = tmp.write(ordinary(runs, pairs))
    each = found.where("uid is not null").select("uid", F.explode("tokens").alias("t")).select("uid", "t.*")
    each = tmp.write(p_ordinary(each, null, pairs).select("uid", "start", "end", "token", "class", "bin"))
    cut = tmp.write(limits(each.select("token", "class", "bin").distinct()))
    span = F.struct("start", F.lit(3).alias("kind"), "end")
    more = each.join(F.broadcast(cut), "class").where("bin >= cut").groupBy("uid").agg(F.collect_set(span).alias("more"))
    # Of a run and a piece inside it, both reported, the run is the span.
    more = more.select("uid", F.filter("more", lambda s: ~F.exists("more", lambda o: (o["start"] <= s["start"]) & (o["end"] >= s["end"]) & (o != s))).alias("more"))
    none = F.array().cast(SPAN)
    second = found.where("uid is not null").join(tmp.write(more), "uid", "left").select("row", "base", F.array_sort(F.concat("base", F.coalesce("more", none))).alias("spans"))
    first = found.where("uid is null").select("row", "base", F.col("base").alias("spans"))
    return first.unionByName(second)


def written_spans(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    with Scratch(docs.sparkSession) as tmp:
        out = scan(docs, ["doc_id"], tmp)
        return tmp.keep(tmp.write(out.select("row.doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])], F.sha2(written_spans(F.col("base")).cast("binary"), 256).alias("base_sha256"), written_spans(F.col("spans")).alias("spans"))))


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span of text replaced by ``[kind]``; overlapping spans are one. n_chars is counted again."""
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    text = F.col("row")["text"]
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        gap = F.substring(text, (s["at"] + 1).cast("int"), F.greatest(x["start"] - s["at"], F.lit(0)).cast("int"))
        new = F.concat(s["out"], F.array(gap, F.get(names, x["kind"])))
        return F.when(x["start"] < s["at"], F.struct(F.greatest(s["at"], x["end"]).alias("at"), s["out"].alias("out"))).otherwise(F.struct(x["end"].alias("at"), new.alias("out")))

    whole = F.aggregate("spans", zero, step, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, (s["at"] + 1).cast("int"), F.length(text))))
    new = F.when(F.size("spans") > 0, whole).otherwise(text)
    with Scratch(docs.sparkSession) as tmp:
        found = scan(docs, docs.columns, tmp).select("row", new.alias("new"))
        columns = []
        for f in docs.schema.fields:
            value = F.col("new") if f.name == "text" else F.length("new").cast(f.dataType) if f.name == "n_chars" else F.col("row")[f.name]
            columns.append(value.alias(f.name))
        return tmp.keep(tmp.write(found.select(*columns)))
