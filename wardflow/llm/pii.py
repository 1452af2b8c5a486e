"""Personal data: generators propose spans, boosted trees score them in context, a calibrated threshold selects.

Everything here is DataFrame functions and Spark ML; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, text_or_empty

# The contract's four kinds, each with its pattern. Repeats that cannot give anything back are written as such, and
# starts inside a run that the search has already given up are ruled out, so long runs cost one pass.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What a text must hold for a pattern to be tried at all.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
# High-recall generators; their spans overlap each other and those above.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:@|\x20?[\[(]at[\])]\x20?|\x20at\x20)[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(]dot[\])]\x20?|\x20dot\x20)[A-Za-z0-9-]++)++",
    "number": r"(?<![0-9])[+(]{0,2}[0-9](?:[\x20().-]{0,2}+[0-9]){6,}+",
}
CONTEXT = 32  # code points before and after a span that the trees see
CUES = {  # fixed values: words near a span
    "cue_phone": "phone|tel|call|mobile|fax|whatsapp", "cue_mail": "mail|contact|write", "cue_card": "card|visa|credit|payment|account", "cue_host": "ip|host|server|addr",
    "cue_item": "order|invoice|item|part|stock|serial|room|ref|version|page|isbn",
}
# No feature tells the base forms (a plus sign with its country code, an @) or the cue that leads up to a span, which
# make the weak label: the trees carry over from those to the forms and places that neither covers.
FEATURES = (
    "length", "digits", "letters", "spaces", "dots", "hyphens", "brackets", "groups", "longest_group", "luhn", "glued_before", "glued_after", "lettered",
    "ending", "mixed", *CUES,
)
BEFORE = r"\b(?:%s)[a-z]*[^0-9a-z]{0,4}(?:(?:is|me|us|no|number|at|on|under)\b[^0-9a-z]{0,4}){0,3}\z"  # a cue that leads up to a span
SAMPLE = 20_000  # candidates the trees are fitted on at most


def _totals(lengths: Column) -> Column:
    """Sums of the lengths up to each place, in blocks so that an array of many is not copied once per element."""
    block = 256
    numbers = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / block).cast("int"))
    add = lambda a, x: a + x
    last = lambda a: F.when(F.size(a) > 0, F.element_at(a, -1)).otherwise(F.lit(0))
    running = lambda xs: F.aggregate(xs, F.array().cast("array<int>"), lambda a, x: F.concat(a, F.array(last(a) + x)))
    part = lambda b: F.slice(lengths, b * block + 1, F.lit(block))
    before = running(F.transform(numbers, lambda b: F.aggregate(part(b), F.lit(0), add)))
    rows = F.transform(F.arrays_zip(numbers.alias("b"), before.alias("upto")), lambda z: F.transform(
        running(part(z["b"])), lambda x: x + z["upto"] - F.aggregate(part(z["b"]), F.lit(0), add)))
    return F.flatten(rows)


def _pieces(text: Column, pattern: str, needs: str) -> Column:
    """The text cut before each match, a mark ending the match in its piece; one piece if nothing matches.

    Texts that hold the two marks have them replaced, which changes no position and no match.
    """
    clean = F.translate(text, "\u0001\u0002", "\u0003\u0003")
    marked = F.regexp_replace(clean, F.lit(pattern), F.lit("\u0001$0\u0002"))
    marked = F.when(F.contains(clean, F.lit(needs)), marked).otherwise(clean) if needs else marked
    return F.split(marked, "\u0001")


def with_matches(rows: DataFrame, text: str, patterns: dict[str, str], needs: dict[str, str], prefix: str) -> DataFrame:
    """Add, for each pattern, an array of (start, end, match) in code points, by start.

    Step by step in projections of their own, each used more than once by the next, so none is evaluated twice.
    """
    for kind, pattern in patterns.items():
        at = f"{prefix}{kind}"
        rows = rows.withColumn("_pieces", _pieces(F.col(text), pattern, needs.get(kind, "")))
        rows = rows.withColumn("_found", F.when(F.size("_pieces") > 1, F.transform("_pieces", lambda p: F.struct(
            (F.char_length(p) - F.when(F.contains(p, F.lit("\u0002")), 1).otherwise(0)).alias("length"), F.substring_index(p, "\u0002", 1).alias("match"),
        )))).drop("_pieces")
        rows = rows.withColumn("_lengths", F.transform("_found", lambda f: f["length"]))
        rows = rows.withColumn("_ends", F.when(F.col("_found").isNotNull(), _totals(F.col("_lengths"))))
        count = F.size("_found") - 1
        rows = rows.withColumn(at, F.when(F.col("_found").isNotNull(), F.zip_with(
            F.slice("_ends", 1, count), F.slice("_found", 2, count),
            lambda e, f: F.struct(e.cast("bigint").alias("start"), (e + F.char_length(f["match"])).cast("bigint").alias("end"), f["match"].alias("match")),
        )).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,match:string>>"))).drop("_found", "_lengths", "_ends")
    return rows


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of 13 to 19 digits passes the check sum; false for other lengths."""
    ordered = F.split(F.reverse(number), "")
    value = lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(x.cast("int") * 2 - F.when(x.cast("int") > 4, 9).otherwise(0))
    total = F.aggregate(F.transform(ordered, value), F.lit(0), lambda a, x: a + x)
    return F.when(F.length(number).between(13, 19), total % 10 == 0).otherwise(False)


def octets(match: Column) -> Column:
    """Whether all dotted parts are at most 255, whatever their leading zeros."""
    def small(part: Column) -> Column:
        plain = F.regexp_replace(part, "^0+", "")
        return F.when(F.length(plain) <= 3, F.when(plain == "", 0).otherwise(plain.cast("int")) <= 255).otherwise(False)

    return F.forall(F.split(match, r"\."), small)


ACCEPT = {
    "email": lambda m: F.lit(True),
    "ip": octets,
    "card": lambda m: luhn(digits(m)),
    "phone": lambda m: F.length(digits(m)).between(9, 15),
}


def _holding(matches: str, kind: str) -> Column:
    return F.transform(F.filter(matches, lambda s: ACCEPT[kind](s["match"])), lambda s: F.struct(F.lit(kind).alias("kind"), s["start"], s["end"]))


def _proposed(matches: str, generator: str) -> Column:
    return F.transform(matches, lambda s: F.struct(F.lit(generator).alias("by"), s["start"], s["end"], s["match"]))


def base_spans(rows: DataFrame, text: str) -> DataFrame:
    """Add `base`: kind, start and end of the matches that hold, by kind as listed, then start."""
    rows = with_matches(rows, text, BASE, NEEDS, "_b_")
    spans = [_holding(f"_b_{kind}", kind) for kind in BASE]
    return rows.withColumn("base", F.flatten(F.array(*spans))).drop(*[f"_b_{kind}" for kind in BASE])


def proposals(rows: DataFrame, text: str) -> DataFrame:
    """Add `loose`: the generators' spans with the text around them, whether a base span overlaps, and whether one of their own sort does."""
    rows = with_matches(rows, text, LOOSE, {}, "_l_")
    spans = [_proposed(f"_l_{g}", g) for g in LOOSE]
    overlaps = lambda b, s: (b["start"] < s["end"]) & (s["start"] < b["end"])
    of_sort = lambda b, s: F.when(s["by"] == "email", b["kind"] == "email").otherwise(b["kind"].isin("card", "phone"))
    around = lambda s: F.struct(
        s["by"], s["start"], s["end"], s["match"],
        F.substring(F.col(text), F.greatest(s["start"] - CONTEXT, F.lit(0)).cast("int") + 1, F.least(s["start"], F.lit(CONTEXT)).cast("int")).alias("left"),
        F.substring(F.col(text), s["end"].cast("int") + 1, F.lit(CONTEXT)).alias("right"),
        F.exists("base", lambda b: overlaps(b, s)).alias("known"), F.exists("base", lambda b: overlaps(b, s) & of_sort(b, s)).alias("sure"),
    )
    return rows.withColumn("_spans", F.flatten(F.array(*spans))).withColumn("loose", F.transform("_spans", around)).drop("_spans", *[f"_l_{g}" for g in LOOSE])


def features(candidates: DataFrame) -> DataFrame:
    """Format and context of each candidate as one vector, its weak label, and whether there is evidence against it.

    The label is evidence that no feature holds: a base span of the same sort overlaps, or a cue leads right up to the
    span (a mail cue to an email that ends in letters, a phone cue to 7 to 12 digits, a card cue to a number whose check
    sum holds). Against a candidate without a label speak a base span of another sort, the word for an item that leads up
    to it, letters or digits glued to it, a failed check sum or an ending that is no name. Formats are those of the plain form, however at and dot are written and without a country code.
    """
    whole, near, left = F.col("match"), F.lower(F.concat_ws(" ", "left", "right")), F.lower("left")
    plain = F.regexp_replace(F.regexp_replace(whole, r"\x20?[\[(]at[\])]\x20?|\x20at\x20", "@"), r"\x20?[\[(]dot[\])]\x20?|\x20dot\x20", ".")
    m = F.when(F.col("by") == "email", plain).otherwise(F.regexp_replace(whole, r"\A\+[0-9]{1,3}[\x20.-]", ""))
    number = digits(m)
    groups = F.filter(F.split(m, "[^0-9]+"), lambda g: g != "")
    ending = plain.rlike(r"\.[A-Za-z]{2,}\z")
    values = {
        "length": F.char_length(m), "digits": F.length(number), "letters": F.regexp_count(m, F.lit("[A-Za-z]")), "spaces": F.regexp_count(m, F.lit(" ")),
        "dots": F.regexp_count(m, F.lit("[.]")), "hyphens": F.regexp_count(m, F.lit("-")), "brackets": F.regexp_count(m, F.lit(r"[()]")),
        "groups": F.size(groups), "longest_group": F.coalesce(F.array_max(F.transform(groups, F.length)), F.lit(0)), "luhn": luhn(number),
        "glued_before": F.col("left").rlike(r"[A-Za-z0-9]\z"), "glued_after": F.col("right").rlike(r"\A[A-Za-z0-9]"),
        "lettered": F.col("by") == "email", "ending": ending, "mixed": whole.rlike(r"\x20at\x20[A-Za-z0-9-]+\."),
        **{cue: near.rlike(rf"\b(?:{words})") for cue, words in CUES.items()},
    }
    table = candidates.select("*", *[values[f].cast("double").alias(f) for f in FEATURES])
    loose_ends = (F.col("glued_before") == 0) & (F.col("glued_after") == 0)
    called = left.rlike(BEFORE % CUES["cue_phone"]) & F.length(digits(whole)).between(7, 12) & loose_ends
    charged = left.rlike(BEFORE % CUES["cue_card"]) & luhn(digits(whole)) & loose_ends
    written = left.rlike(BEFORE % CUES["cue_mail"]) & (F.col("ending") == 1)
    label = F.col("sure") | F.when(F.col("by") == "email", written).otherwise(called | charged)
    refused = F.when(F.col("by") == "email", F.col("ending") == 0).otherwise(
        left.rlike(BEFORE % CUES["cue_item"]) | ~loose_ends | (F.length(digits(whole)) >= 13) & ~luhn(digits(whole)))
    table = table.withColumn("label", label.cast("double")).withColumn("against", ~label & (F.col("known") | refused))
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(table).drop(*FEATURES)


def score() -> Column:
    """The trees' score in thousandths, for the threshold and for what it selects."""
    return F.round(vector_to_array("probability")[1], 3)


def fit(candidates: DataFrame, precision: float, sample: int = SAMPLE):
    """Trees and a threshold, or None where candidates of one sort only are found.

    Of one half of the candidates by hash, at most `sample` fit the trees. All of the other half set the threshold: the
    least score, 0.5 or more, from which on the labelled are at least the share `precision` of those that the evidence
    speaks for or against. The label is made of what the trees do not see, so the share says how often their choice is
    confirmed; spans with no evidence either way, which the trees are there to find, have no say in it.
    """
    order = F.xxhash64("row", "start", "by")
    half = lambda part: candidates.filter(F.pmod(order, F.lit(2)) == part)
    train = saved(features(half(0).orderBy(order, "row", "start", "by").limit(sample)).select("features", "label"))
    if train.select("label").distinct().count() < 2:
        return None
    model = GBTClassifier(maxDepth=3, maxIter=8, stepSize=0.3, seed=7).fit(train)
    scored = model.transform(features(half(1))).filter((F.col("label") == 1) | F.col("against")).select(score().alias("score"), F.col("label").cast("int").alias("hit"))
    steps = scored.groupBy("score").agg(F.count("*").alias("n"), F.sum("hit").alias("k")).orderBy(F.desc("score")).collect()  # 1001 rows at most
    best, n, k = None, 0, 0
    for step in steps:
        n, k = n + step["n"], k + step["k"]
        if k >= precision * n:
            best = step["score"]
    return None if best is None else (model, max(best, 0.5))


def find(docs: DataFrame, precision: float = 0.98, sample: int = SAMPLE) -> DataFrame:
    """One row per document: `base` and `spans`, arrays of (kind, start, end) by kind as listed, then start.

    `base` holds the contract's matches. `spans` also holds proposals that no base span overlaps and that the trees
    score at or above the calibrated threshold; nothing else selects them. Those of the email generator are emails, numbers of 13 digits
    or more cards, shorter ones phones. A null or empty text has no spans. Repeated rows and null ids give
    one row each; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("_text"))
    known = saved(proposals(base_spans(rows, "_text"), "_text").select("doc_id", "base", "loose"))
    known = known.withColumn("row", F.monotonically_increasing_id())  # of the written rows, so the same in every read
    candidates = known.select("row", F.explode("loose").alias("c")).select("row", "c.*")
    fitted = fit(candidates, precision, sample)
    if fitted is None:
        return known.select("doc_id", "base", F.col("base").alias("spans"))
    model, threshold = fitted
    kind = F.when(F.col("by") == "email", "email").when(F.length(digits(F.col("match"))) >= 13, "card").otherwise("phone")
    extra = (
        model.transform(features(candidates.filter(~F.col("known")))).filter(score() >= threshold)
        .groupBy("row").agg(F.collect_list(F.struct(kind.alias("kind"), "start", "end")).alias("extra"))  # the spans of one text
    )
    places = F.array(*map(F.lit, BASE))
    ordered = F.array_sort(F.transform(F.concat("base", F.coalesce("extra", F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>"))), lambda s: F.struct(
        F.array_position(places, s["kind"]).alias("place"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return known.select("row", "doc_id", "base").join(extra, "row", "left").select(
        "doc_id", "base", F.transform(ordered, lambda s: F.struct(s["kind"], s["start"], s["end"])).alias("spans")
    )


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
