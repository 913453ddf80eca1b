"""Secret scans in DataFrame expressions only: fixed patterns, and strings that look random to Markov models.

Two first-order character models, one of random strings and one of ordinary identifiers, are trained
from labelled samples. The evidence for a string is the log-likelihood ratio of its best stretch, so that a key
is found behind a path or a name. Every match of a fixed pattern is judged too: it stays a span whatever
its evidence, which tells a key from a value like `password: changeme`. Other strings are spans with EVIDENCE
or more. A model is a table of 64 x 64 transition weights, whatever the input.

Training: patterns label the values that they catch as random, plain words are labelled ordinary; both
come from all documents, each different string once. Generated samples join them: digests in three
alphabets, identifiers of two usual words each, and times. Transitions that a label's strings show
rarely back off to those between the classes of their signs.

Folds over matches keep what they have gathered in blocks (gathered), so that a text of many matches takes
time in proportion to them.

Defined results: a null text counts as empty and has no spans; repeated rows are scanned alike; without
documents there are no rows, and the models know the generated samples alone. Spans are in code points with
their end exclusive; those of one kind don't overlap, those of different kinds may. A column that is called
as `out` is replaced, all others stay.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import gathered

ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Base kinds in their order: pattern, whether its group is the value (else the whole match), least length of that. Lengths that a whole match must have are in the pattern where that finds the same matches.
BASE = (("assign", ASSIGN, True, 6), ("access", r"AKIA[A-Z0-9]{16,}", False, 20), ("hex", r"[0-9a-f]{24,}", False, 24))
#: Strings that the models judge: runs of at least LEAST of these signs with a letter.
LEAST = 10
CANDIDATE = rf"(?<![A-Za-z0-9+/_=-])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{{{LEAST},}}"
#: Least log-likelihood ratio of a secret's best stretch (README has the measured errors).
EVIDENCE = 18.0
#: Generated random strings of each alphabet.
GENERATED = 1000
#: Signs are numbered by their place here, all others are 63.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+"
SIGNS = 64
#: Words of generated identifiers.
WORDS = "user name value key data file path index count list table time date start end first last next config internal public server client request response handler buffer string number type node error message default parent child module version update create delete load save open close read write test main build page image total result state event order".split()
#: Weight of the class model, in transitions.
BACKOFF = 8.0
SPANS = "array<struct<kind:string,start:int,end:int,value:string>>"


def matches(text: Column, pattern: str, grouped: bool, least: int, kind: str) -> Column:
    """array<struct<kind, start, end, value>> of the pattern's leftmost non-overlapping matches whose value has `least` signs or more.

    What lies between the matches and the matches themselves alternate, so that lengths add up to places.
    """
    between = F.transform(F.split(text, pattern), lambda x: F.length(x))
    whole = F.regexp_extract_all(text, F.lit(f"({pattern})"), 1)
    parts = F.filter(F.arrays_zip(between.alias("gap"), whole.alias("m")), lambda p: p["m"].isNotNull())

    def step(state: list[Column], p: Column):
        start = state[0] + p["gap"]
        end = start + F.length(p["m"])
        return [end], F.array(F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), (F.regexp_extract(p["m"], pattern, 1) if grouped else p["m"]).alias("value")))

    found = gathered(parts, [F.lit(0)], SPANS[6:-1], step)
    return F.when(text.rlike(pattern), F.filter(found, lambda x: F.length(x["value"]) >= least)).otherwise(F.array().cast(SPANS))


def numbers() -> Column:
    """The number of each ASCII sign, as a constant array."""
    return F.split(F.lit(",".join(str(ALPHABET.find(chr(k)) if chr(k) in ALPHABET else SIGNS - 1) for k in range(128))), ",").cast("array<int>")


def transition(string: Column, k: Column) -> Column:
    """Number (from 1) of the transition from sign k to the next one."""
    a, b = (F.coalesce(F.get(numbers(), F.ascii(F.substring(string, at, F.lit(1)))), F.lit(SIGNS - 1)) for at in (k, k + 1))
    return a * SIGNS + b + 1


def training_strings(docs: DataFrame, text_col: str) -> DataFrame:
    """`random` (boolean) and `s`: the labelled strings."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    caught = texts.select(F.explode(F.concat(*(matches(F.col("t"), p, g, n, kind) for kind, p, g, n in BASE))).alias("m")).select(F.lit(True).alias("random"), F.col("m.value").alias("s")).where("length(s) >= 12 and s rlike '[0-9]'").distinct()
    words = texts.select(F.explode(F.regexp_extract_all("t", F.lit(r"([A-Za-z]{4,})"), 1)).alias("s")).distinct()
    plain = words.select(F.lit(False).alias("random"), "s")
    digest = F.sha2(F.col("id").cast("string"), 256)
    made = spark.range(GENERATED).select(F.explode(F.array(digest, F.regexp_replace(F.base64(F.unhex(digest)), "=", ""), F.translate(F.substring(digest, 1, 32), "0123456789abcdef", "QZ3X7JKV5WBYHM2P"))).alias("s"))
    usual = F.array(*map(F.lit, WORDS))
    pairs = spark.range(1).select(F.explode(F.flatten(F.transform(usual, lambda a: F.transform(usual, lambda b: F.array(F.concat(a, F.lit("_"), b), F.concat(a, F.initcap(b), F.lit("2")), F.concat(F.upper(a), F.lit("_"), F.upper(b), F.lit("_1")), F.concat(F.initcap(a), F.initcap(b))))))).alias("four")).select(F.explode("four").alias("s"))
    day = F.date_add(F.lit("1990-01-01").cast("date"), (F.col("id") * 13).cast("int")).cast("string")
    times = spark.range(GENERATED).select(F.concat(day, F.lit("T"), F.lpad((F.col("id") % 24).cast("string"), 2, "0")).alias("s"))
    return caught.union(plain).union(made.select(F.lit(True), "s")).union(pairs.union(times).select(F.lit(False), "s"))


def sign_class(k: int) -> int:
    return 0 if k < 26 else 1 if k < 52 else 2 if k < 62 else 3


def log_transitions(counts: list[float]) -> list[float]:
    """Log-probability of each transition from its counts, backed off to classes and then to single signs."""
    single = [0.5] * SIGNS
    between = [[0.5] * 4 for _ in range(4)]
    for k, n in enumerate(counts):
        single[k % SIGNS] += n
        between[sign_class(k // SIGNS)][sign_class(k % SIGNS)] += n
    whole = [sum(single[j] for j in range(SIGNS) if sign_class(j) == c) for c in range(4)]
    out = []
    for a in range(SIGNS):
        row, to = counts[a * SIGNS : (a + 1) * SIGNS], between[sign_class(a)]
        for b in range(SIGNS):
            c = sign_class(b)
            prior = to[c] / sum(to) * single[b] / whole[c]
            out.append(math.log((row[b] + BACKOFF * prior) / (sum(row) + BACKOFF)))
    return out


def fit(docs: DataFrame, text_col: str = "text") -> list[float]:
    """The log-likelihood ratio of each transition, random over ordinary."""
    strings = training_strings(docs, text_col)
    counted = strings.where("length(s) > 1").select("random", "s", F.explode(F.sequence(F.lit(1), F.length("s") - 1)).alias("k")).groupBy("random", transition(F.col("s"), F.col("k")).alias("at")).agg(F.count("*").alias("n"))
    counts = {True: [0.0] * SIGNS**2, False: [0.0] * SIGNS**2}
    for r in counted.collect():  # two rows for each transition at most
        counts[r.random][r["at"] - 1] += r.n
    return [p - q for p, q in zip(log_transitions(counts[True]), log_transitions(counts[False]), strict=True)]


def best_stretch(string: Column, model: list[float]) -> Column:
    """The highest log-likelihood ratio of a stretch of the string."""
    weights = F.split(F.lit(",".join(f"{x:.6f}" for x in model)), ",").cast("array<double>")
    return F.aggregate(
        F.sequence(F.lit(1), F.length(string) - 1),
        F.struct(F.lit(0.0).alias("now"), F.lit(0.0).alias("best")),
        lambda acc, k: F.struct(F.greatest(F.lit(0.0), acc["now"] + F.element_at(weights, transition(string, k))).alias("now"), F.greatest(acc["best"], acc["now"]).alias("best")),
        lambda acc: F.greatest(acc["best"], acc["now"]),
    )


RANKS = ("assign", "access", "hex", "random")


def scan_secrets(docs: DataFrame, model: list[float], text_col: str = "text", out: str = "secrets") -> DataFrame:
    """docs with `out`: array<struct<kind, start, end, evidence>> sorted by start, then kind (assign, access, hex, random).

    evidence is the highest log-likelihood ratio of a stretch of the span's value.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    all_ = f"__found_{uuid.uuid4().hex}"
    order = F.create_map(*(F.lit(x) for pair in zip(RANKS, range(len(RANKS)), strict=True) for x in pair))
    found = F.concat(*(matches(text, p, g, n, kind) for kind, p, g, n in BASE), matches(text, CANDIDATE, False, LEAST, "random"))
    ranked = F.array_sort(F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.element_at(order, x["kind"]).alias("rank"), x["kind"].alias("kind"), x["end"].alias("end"), x["value"].alias("value"))))
    judged = F.transform(clear_of_base(ranked), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), best_stretch(x["value"], model).alias("evidence")))
    return docs.withColumn(all_, judged).withColumn(out, F.filter(all_, lambda x: (x["kind"] != "random") | (x["evidence"] >= EVIDENCE))).drop(all_)


def clear_of_base(ranked: Column) -> Column:
    """ranked (sorted by start, base kinds first) without the spans of kind random that overlap a base span: one walk for those before, one back for those after."""
    kind = "struct<start:int,rank:int,kind:string,end:int,value:string>"
    none = F.array().cast(f"array<{kind}>")
    random = lambda x: x["rank"] == len(BASE)

    def after(state: list[Column], x: Column):
        return [F.when(random(x), state[0]).otherwise(F.greatest(state[0], x["end"]))], F.when(random(x) & (state[0] > x["start"]), none).otherwise(F.array(x))

    def before(state: list[Column], x: Column):
        return [F.when(random(x), state[0]).otherwise(F.least(state[0], x["start"]))], F.when(random(x) & (state[0] < x["end"]), none).otherwise(F.array(x))

    return F.reverse(gathered(F.reverse(gathered(ranked, [F.lit(-1)], kind, after)), [F.lit(2**31 - 1)], kind, before))


def redacted(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """text with each span, or run of spans that overlap, replaced by the mask.

    Pieces are cut from four bytes a code point, so that each takes time by its own length.
    """
    closing = F.struct(F.length(text).alias("start"), F.length(text).alias("end"), F.lit("").alias("mask"))
    parts = F.concat(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(mask).alias("mask"))), F.array(closing))

    def step(state: list[Column], x: Column):
        at, raw = state
        piece = F.decode(F.substring(raw, at * 4 + 1, (x["start"] - at) * 4), "UTF-32")
        made = F.when((x["start"] < at) & (x["mask"] != ""), F.array().cast("array<string>")).otherwise(F.array(piece, x["mask"]))
        return [F.greatest(at, x["end"]), raw], made

    walked = gathered(parts, [F.lit(0), F.encode(text, "UTF-32")], "string", step)
    return F.when(F.size(spans) == 0, text).otherwise(F.array_join(walked, ""))


def joined_spans(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
