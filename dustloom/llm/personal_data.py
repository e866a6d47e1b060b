"""Personal data by candidate gradient boosting, in DataFrame functions alone.

Exact patterns give the base spans, which always stay. High-recall generators propose more spans, which may overlap
them and each other: mails and addresses with spelled-out or bracketed signs, digit groups of the length of cards and
phones. Each has features of its format (digits, check sum, separators, octets, form of a date) and of its context
(words before, what it is glued to). What is learnt from:

- positive: each base span rewritten in the forms that the exact patterns don't know (an @ spelled out, dots bracketed,
  a phone without its plus), in its own context; and candidates that overlap a base span of their kind;
- negative: candidates that fail their kind's own check or overlap a base span of another kind; and each base span
  spoilt (an octet or a digit changed, the domain's end or most digits cut off), so that every kind has both;
- the others are unlabelled, and it is them that the trees decide on.

Counts of feature patterns over all documents, a table whose size the features bound, train boosted trees; on a
held-out fold a threshold for each kind is the lowest score from which on at least PRECISION of the labelled candidates
are positive. Unlabelled candidates from their threshold on are added unless they overlap a base span or such a candidate
of an earlier kind. Overlaps are found by running maxima and minima over a document's candidates in order, so the work
grows with their number and not with its square.

A pattern's matches are found by marking them in the text and cutting it at the marks; positions are running
sums of the parts' lengths, so positions count code points and no row leaves its task. Patterns have no repeated groups,
on which Java's matcher recurses: what may separate digits or labels is marked in a pass of its own.

Defined results: null counts as empty; texts without candidates have no spans; without base spans there is nothing to
learn from and nothing is added; rows that repeat an identifier are each on their own; control characters U+0001 to U+0004 in a text are no part of any span.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dustloom.llm.common import row_struct, scratch

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.99
TREES, DEPTH = 8, 3
CONTEXT = 24
OPEN, CLOSE, GAP, DOT = "\u0001", "\u0002", "\u0003", "\u0004"
#: Fixed patterns. GAP stands for one space or dash between digits, DOT for a dot between letters, digits or dashes.
LOCAL = rf"[A-Za-z0-9._%+{DOT}-]"
LABEL = r"[A-Za-z0-9-]"
BASE = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@{LABEL}++{DOT}[A-Za-z0-9{DOT}-]++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": rf"[0-9][0-9{GAP}]++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What may stand for a dot of an address.
SPLIT = r"(?:\.|\[\.\]|\(\.\)| \. )"
LOOSE = {
    "email": rf"(?<!{LOCAL}){LOCAL}++(?:(?:@| ?[\[(](?i:at)[\])] ?){LABEL}++(?:(?:{DOT}| ?[\[(](?i:dot)[\])] ?)[A-Za-z0-9{DOT}-]++)?| (?i:at) {LABEL}++ (?i:dot) {LABEL}++(?: (?i:dot) {LABEL}++)?)",
    "ip": rf"(?<![0-9])[0-9]++{SPLIT}[0-9]++{SPLIT}[0-9]++{SPLIT}[0-9]++",
    "card": rf"(?<![0-9])[0-9](?=[0-9{GAP}]{{11}})[0-9{GAP}]++",
    "phone": r"(?<![\w+.])(?:00[1-9][0-9]{0,2}[ .-]?[ ().0-9-]{6,18}[0-9]|\(?[0-9]{2,5}\)?[ ./-][0-9]{2,5}[ ./-][0-9]{2,5}(?:[ ./-][0-9]{2,5})?(?:[ ./-][0-9]{2,5})?)(?!\w)",
}
DATE = r"^(?:(?:19|20)[0-9]{2}[ ./-][01]?[0-9][ ./-][0-3]?[0-9]|[0-3]?[0-9][ ./-][0-3]?[0-9][ ./-](?:19|20)[0-9]{2})$"
#: A text without a hit of these can't hold the kind.
MAY_HOLD = {"email": r"@|[\[(](?i:at)[\])]| (?i:at) [A-Za-z0-9-]+ (?i:dot) ", "ip": r"[0-9] ?[\[(]?\.", "card": r"[0-9](?:[ -]?[0-9]){11}", "phone": r"\+[0-9]|[0-9]\)?[ ./-][0-9]|00[0-9]"}
#: Words before a candidate that tell of a kind, by kind.
CUES = {"email": "mail|contact|write", "ip": "ip|host|server|address|addr", "card": "card|visa|pay|credit|account", "phone": "phone|tel|call|mobile|fax"}
FEATURES = ("kind", "digits", "luhn", "dots", "plus", "parens", "cue", "glued", "at_sign", "octets", "date")
BLOCK = 64


def _hits(marked: Column) -> Column:
    """Parts of a marked text: the first is no hit, each other is a hit, CLOSE and what follows it."""
    return F.split(marked, OPEN, -1)


def _let(value: Column, body) -> Column:
    """body(value) with value computed once; within lambdas the optimiser would copy it to where it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _starts(lengths: Column) -> Column:
    """Running sums before each element, by blocks, so that many hits in a text don't take quadratic time."""
    add = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    blocks = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int"))
    sums = F.transform(blocks, lambda b: add(F.slice(lengths, b * BLOCK + 1, BLOCK)))
    within = lambda b, before: F.transform(F.sequence(F.lit(0), F.lit(BLOCK - 1)), lambda i: before + add(F.slice(lengths, b * BLOCK + 1, i)))
    return _let(sums, lambda s: F.flatten(F.transform(blocks, lambda b: _let(add(F.slice(s, 1, b)), lambda before: within(b, before)))))


def _spans(df: DataFrame, name: str, source: str, pattern: str, flag: Column) -> DataFrame:
    """df with name: array of (start, end, hit, before)."""
    none = F.array(F.lit(""))
    df = df.withColumn(f"{name}_parts", F.when(flag, _hits(F.regexp_replace(source, F.lit(pattern), F.lit(f"{OPEN}$0{CLOSE}")))).otherwise(none))
    df = df.withColumn(f"{name}_lengths", F.transform(f"{name}_parts", lambda x, i: (F.length(x) - F.when(i > 0, 1).otherwise(0)).cast("long")))
    df = df.withColumn(f"{name}_starts", F.when(F.size(f"{name}_parts") > 1, _starts(F.col(f"{name}_lengths"))))
    parts, starts = F.col(f"{name}_parts"), F.col(f"{name}_starts")

    def span(i: Column) -> Column:
        part, before = F.element_at(parts, i + 1), F.element_at(parts, i)
        hit, start = F.substring_index(part, CLOSE, 1), F.element_at(starts, i + 1)
        return F.struct(start.alias("start"), (start + F.length(hit)).alias("end"), hit.alias("hit"), F.right(F.substring_index(before, CLOSE, -1), F.lit(CONTEXT)).alias("before"))

    spans = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), span)
    empty = F.array().cast("array<struct<start:bigint,end:bigint,hit:string,before:string>>")
    return df.withColumn(name, F.when(F.size(parts) > 1, spans).otherwise(empty)).drop(f"{name}_parts", f"{name}_lengths", f"{name}_starts")


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def term(c, i):
        digit = F.coalesce(c.try_cast("int"), F.lit(0))  # the last part is empty
        return F.when(i % 2 == 0, digit).otherwise(digit * 2 - F.when(digit > 4, 9).otherwise(0))

    values = F.transform(F.split(F.reverse(digits), "(?!^)"), term)
    return (F.length(digits) > 0) & (F.aggregate(values, F.lit(0), lambda s, x: s + x) % 10 == 0)


def _octets(hit: Column) -> Column:
    return F.forall(F.split(F.regexp_replace(hit, r"[\[\]() ]", ""), r"\."), lambda x: F.coalesce(x.try_cast("bigint") <= 255, F.lit(False)))


def _holds(kind: str, hit: Column) -> Column:
    """Whether a hit of a base pattern passes the kind's own check."""
    n = F.length(_digits(hit))
    return {"email": F.lit(True), "ip": _octets(hit), "card": n.between(16, 19) & _luhn(_digits(hit)), "phone": n.between(8, 15)}[kind]


def _features(kind: str, s: Column) -> list[Column]:
    hit, before = s["hit"], F.lower(s["before"])
    yes = lambda c: F.when(c, 1).otherwise(0)
    n = F.length(_digits(hit))
    cue = F.lit(0)
    for i, k in enumerate(KINDS):
        cue = F.when(before.rlike(CUES[k]), i + 1).otherwise(cue)
    values = [
        F.lit(KINDS.index(kind)),
        F.least(n, F.lit(20)),
        yes(n.between(12, 19) & _luhn(_digits(hit))),
        F.least(F.length(F.regexp_replace(F.regexp_replace(hit, r"(?i)[\[( ]dot[\]) ]", DOT), rf"[^.{DOT}]", "")), F.lit(4)),
        yes(hit.startswith("+") | before.endswith("+") | before.rlike(r"\+[0-9]+ ?$")),
        yes(hit.contains("(")),
        cue,
        yes(before.rlike(r"[\p{L}\p{N}_]$")),
        yes(hit.contains("@")),
        yes(_octets(hit)) if kind == "ip" else F.lit(0),
        yes(hit.rlike(DATE)) if kind == "phone" else F.lit(0),
    ]
    return [v.cast("int").alias(f) for v, f in zip(values, FEATURES, strict=True)]


def _fails(kind: str, hit: Column) -> Column:
    """A candidate that is known to be none."""
    n = F.length(_digits(hit))
    return {"email": ~F.lower(hit).rlike(rf"{DOT}|dot"), "ip": ~_octets(hit), "card": ~(n.between(13, 19) & _luhn(_digits(hit))), "phone": ~n.between(7, 15) | hit.rlike(DATE)}[kind]


def _rewritten(kind: str, hit: Column) -> list[tuple[Column, int]]:
    """Forms of a base span that the exact patterns miss (1), and spoilt ones (0)."""
    put = lambda old, new: F.replace(hit, F.lit(old), F.lit(new))
    digits, last = _digits(hit), F.right(hit, F.lit(1)).try_cast("int")
    if kind == "email":
        forms = [F.replace(put("@", a), F.lit(DOT), F.lit(d)) for a, d in ((" at ", " dot "), ("[at]", "[dot]"), ("(at)", DOT))]
        return [*((f, 1) for f in forms), (F.substring_index(put("@", "[at]"), DOT, 1), 0)]
    if kind == "ip":
        return [(put(".", "[.]"), 1), (put(".", " . "), 1), (F.concat(F.lit("999"), put(".", "[.]")), 0)]
    if kind == "card":
        return [(hit, 1), (F.concat(hit.substr(F.lit(1), F.length(hit) - 1), ((last + 1) % 10).cast("string")), 0)]
    plain = F.substring(hit, 2, 100)
    national = F.regexp_replace(plain, "^[0-9]{1,3}[ .-]", "")
    return [(plain, 1), (national, 1), (F.concat(F.lit("00"), plain), 1), (F.left(digits, F.lit(6)), 0), (F.concat(F.lit("20"), F.left(digits, F.lit(2)), F.lit("-01-02")), 0)]


def _place(s: Column) -> Column:
    return F.struct(s["start"].alias("start"), s["end"].alias("end"))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """uid, doc_id, fold, base_<kind> of each row; loose: its candidates, forms: rewritten base spans, with features and label. Written."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    df = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(f"`{id_col}`").alias("doc_id"), *([row_struct(docs, "row")] if keep else []), F.translate(text, OPEN + CLOSE + GAP + DOT, "\u0005" * 4).alias("clean"))
    df = df.withColumns({f"may_{k}": F.col("clean").rlike(MAY_HOLD[k]) for k in KINDS})
    gaps = F.regexp_replace("clean", F.lit("(?<=[0-9])[ -](?=[0-9])"), F.lit(GAP))
    dots = F.regexp_replace("clean", F.lit(rf"(?<={LABEL})\.(?={LABEL})"), F.lit(DOT))
    df = df.withColumns({"for_card": F.when(F.col("may_card"), gaps), "for_email": F.when(F.col("may_email"), dots)})
    source = {"email": "for_email", "ip": "clean", "card": "for_card", "phone": "clean"}
    for k in KINDS:
        df = _spans(df, f"base_{k}", source[k], BASE[k], F.col(f"may_{k}"))
        df = _spans(df, f"loose_{k}", source[k], LOOSE[k], F.col(f"may_{k}"))
    fold = F.pmod(F.xxhash64("clean"), F.lit(4)).cast("int")

    def checked(k: str) -> Column:
        return F.filter(f"base_{k}", lambda s: _holds(k, s["hit"]))

    df = df.withColumns({f"base_{k}": checked(k) for k in KINDS})

    def marked(k: str) -> Column:
        return F.transform(f"loose_{k}", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(_fails(k, s["hit"]), 0).cast("int").alias("label"), *_features(k, s)))

    def forms(k: str) -> Column:
        def one(s: Column) -> Column:
            before = s["before"].alias("before")
            return F.array(*(F.struct(F.lit(label).alias("label"), *_features(k, F.struct(hit.alias("hit"), before))) for hit, label in _rewritten(k, s["hit"])))

        return F.flatten(F.transform(f"base_{k}", one))

    keep_cols = ["uid", "doc_id", *(["row"] if keep else [])]
    loose, made = F.concat(*map(marked, KINDS)), F.concat(*map(forms, KINDS))
    return scratch(df.select(*keep_cols, fold.alias("fold"), *(F.transform(f"base_{k}", _place).alias(f"base_{k}") for k in KINDS), loose.alias("loose"), made.alias("forms")), "personal")


def _meets(df: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """df (uid, start, end) with a column for each test: whether a row of the document that passes it overlaps this one.

    Rows that pass a test are passed in order of their starts: the largest end of those that begin before or with this
    row, and the smallest start of those that begin after it, say whether one overlaps.
    """
    order = Window.partitionBy("uid").orderBy("start")
    upto, after = order.rangeBetween(Window.unboundedPreceding, 0), order.rangeBetween(1, Window.unboundedFollowing)
    over = {n: F.coalesce(F.max(F.when(t, F.col("end"))).over(upto) > F.col("start"), F.lit(False)) | F.coalesce(F.min(F.when(t, F.col("start"))).over(after) < F.col("end"), F.lit(False)) for n, t in tests.items()}
    return df.withColumns(over)


def labelled(found: DataFrame) -> DataFrame:
    """One row a candidate: uid, fold, start, end, its features, label, and whether it meets a base span. Written."""

    def numbered(k: str) -> Column:
        return F.transform(f"base_{k}", lambda s: F.struct(F.lit(KINDS.index(k)).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    spans = F.concat(*map(numbered, KINDS))
    base = found.where(F.size("loose") > 0).select("uid", "fold", F.explode(spans).alias("b")).select("uid", "fold", F.col("b.start").alias("start"), F.col("b.end").alias("end"), F.col("b.kind").alias("base_kind"))
    loose = found.select("uid", "fold", F.explode("loose").alias("c")).select("uid", "fold", "c.*")
    both = loose.unionByName(base, allowMissingColumns=True)
    kinds = {f"meets_{k}": F.coalesce(F.col("base_kind") == i, F.lit(False)) for i, k in enumerate(KINDS)}
    met = _meets(both, kinds).where("base_kind IS NULL").drop("base_kind")
    own = F.lit(False)
    for i, k in enumerate(KINDS):
        own = F.when(F.col("kind") == i, F.col(f"meets_{k}")).otherwise(own)
    every = F.lit(False)
    for k in KINDS:
        every = every | F.col(f"meets_{k}")
    label = F.when(own, 1).when(F.col("label") == 0, 0).when(every, 0)
    return scratch(met.withColumns({"label": label.cast("int"), "meets_base": every}).drop(*kinds), "labelled")


def _tree(lines: list[str], at: int, value) -> tuple[Column, int]:
    """A tree's debug text as nested conditions."""
    if m := re.match(r"\s*Predict: (\S+)", lines[at]):
        return F.lit(float(m[1])), at + 1
    m = re.match(r"\s*If \(feature (\d+) <= (\S+)\)", lines[at])
    if not m:
        raise ValueError(lines[at])
    low, at = _tree(lines, at + 1, value)
    high, at = _tree(lines, at + 1, value)
    return F.when(value(int(m[1])) <= float(m[2]), low).otherwise(high), at


class Booster:
    """Boosted trees as a column expression, with a threshold for each kind (None: nothing is added)."""

    def __init__(self, patterns: DataFrame):
        """patterns: FEATURES, label, fold, n; at most as many rows as the features have values."""
        self.trees, self.thresholds = [], dict.fromkeys(KINDS)
        patterns = scratch(patterns.coalesce(1), "patterns")
        if {r[0] for r in patterns.where("fold <> 0").select("label").distinct().collect()} != {0, 1}:
            return
        made = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(patterns.withColumn("weight", F.col("n").cast("double")).withColumn("target", F.col("label").cast("double")))
        model = GBTClassifier(labelCol="target", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=5).fit(made.where("fold <> 0"))
        self.trees = [(w, t.toDebugString.strip().split("\n")[1:]) for w, t in zip(model.treeWeights, model.trees, strict=True)]
        scored = patterns.where("fold = 0").select("kind", "label", "n", self.score(F.col).alias("score"))
        rows = scored.groupBy("kind", "score").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("label")).alias("p")).orderBy("kind", F.desc("score")).collect()
        for i, kind in enumerate(KINDS):
            n = p = 0
            for r in (r for r in rows if r["kind"] == i):
                n, p = n + r["n"], p + r["p"]
                if p >= PRECISION * n and r["score"] > 0.5:
                    self.thresholds[kind] = r["score"]

    def score(self, value) -> Column:
        """value: a feature's column by name. The logistic of twice the margin."""
        margin = F.lit(0.0)
        for weight, lines in self.trees:
            margin = margin + F.lit(float(weight)) * _tree(lines, 0, lambda i: value(FEATURES[i]))[0]
        return 1 / (1 + F.exp(-2 * margin))


def train(found: DataFrame, rows: DataFrame) -> Booster:
    """rows: what labelled gives of found."""
    own = rows.where("label IS NOT NULL").select("fold", "label", *FEATURES)
    made = found.select("fold", F.explode("forms").alias("f")).select("fold", "f.label", *(f"f.{x}" for x in FEATURES))
    return Booster(own.union(made).groupBy("fold", "label", *FEATURES).agg(F.count(F.lit(1)).alias("n")))


def select(found: DataFrame, rows: DataFrame, booster: Booster) -> DataFrame:
    """found with spans_<kind>: the base spans and those that the booster adds, by start."""
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    enough = F.lit(False)
    for i, k in enumerate(KINDS):
        if booster.thresholds[k] is not None:
            enough = F.when(F.col("kind") == i, F.col("score") >= booster.thresholds[k]).otherwise(enough)
    good = rows.where("label IS NULL AND NOT meets_base").withColumn("score", booster.score(F.col)).where(enough).select("uid", "start", "end", "kind")
    good = _meets(good, {f"meets_{i}": F.col("kind") == i for i in range(len(KINDS) - 1)})
    earlier = F.lit(False)
    for i in range(len(KINDS) - 1):
        earlier = earlier | ((F.col("kind") > i) & F.col(f"meets_{i}"))
    added = good.where(~earlier).groupBy("uid").agg(*(F.collect_list(F.when(F.col("kind") == i, F.struct("start", "end"))).alias(f"added_{k}") for i, k in enumerate(KINDS)))
    df = found.drop("loose", "forms").join(added, "uid", "left")
    return df.withColumns({f"spans_{k}": F.array_sort(F.concat(f"base_{k}", F.coalesce(f"added_{k}", none))) for k in KINDS})


def _joined(prefix: str) -> Column:
    def text(k: str) -> Column:
        return F.transform(f"{prefix}_{k}", lambda s: F.concat(F.lit(f"{k}:"), s["start"], F.lit(":"), s["end"]))

    return F.concat_ws(",", F.concat(*map(text, KINDS)))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_<kind> (base spans), base_sha256, spans for each row of docs."""
    found = candidates(docs, id_col, text_col)
    rows = labelled(found)
    out = select(found, rows, train(found, rows))
    return out.select("doc_id", *(F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS), F.sha2(_joined("base").cast("binary"), 256).alias("base_sha256"), _joined("spans").alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with each span of personal data replaced by its kind in brackets; of overlapping spans the first stands for both."""
    found = candidates(docs, id_col, text_col, keep=True)
    rows = labelled(found)
    out = select(found, rows, train(found, rows))

    def tagged(k: str) -> Column:
        return F.transform(f"spans_{k}", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(f"[{k.upper()}]").alias("tag")))

    every = F.concat(*map(tagged, KINDS))
    out = out.withColumn("every", F.array_sort(every))
    text = F.coalesce(F.col("row").getField(text_col), F.lit(""))

    def step(acc, s):
        at = F.greatest(acc["at"], s["start"])
        more = F.when(s["start"] >= acc["at"], F.concat(acc["text"], F.substring(text, acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int")), s["tag"])).otherwise(acc["text"])
        return F.struct(F.greatest(at, s["end"]).alias("at"), more.alias("text"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("text"))
    clean = F.aggregate("every", start, step, lambda acc: F.concat(acc["text"], F.substring(text, acc["at"].cast("int") + 1, F.length(text))))
    return out.select(*(clean.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns))
