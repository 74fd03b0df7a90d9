"""Personal data by fixed patterns, and by bootstrapped contextual extraction; DataFrame functions only.

Spans of the four base kinds (email, ip, card, phone) are the seeds. The contexts of an entity are the words before and
after it, each of the two alone, and its own form (digits and letters by one sign each) beside what sort of word precedes
or follows. Identifier-like tokens (those with a digit or an ``@``, and phones and cards of several words) in the same
contexts are instances; contexts and instances form a weighted graph. Every pair of context and kind is scored by itself,
over the seeds of that kind and the unseen tokens whose shape fits it. Each round scores a pair by the mean belief in its
instances and an instance by the best of its contexts, seeds keeping belief 1. Pairs with enough distinct seeds and a high
score are trusted: an unseen token that fits the kind is added as a span of that kind.

Only contexts that hold a seed enter the graph, instances are aggregated by (context, token) before any shuffle, and
scores are sums and maxima per key, so a frequent context costs one row per distinct token and task.

Offsets count code points; ends are exclusive. Defined results: null or empty text has no spans (empty strings, zeros and
the SHA-256 of the empty string). Extra columns are ignored, repeated rows are searched each, a null id is kept. An empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from timberline.llm.common import pin

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns. The possessive forms match what the plain ones match (nothing follows a repeat that it could give back
#: to), in linear time and without deep recursion. ``\G`` lets a match start right after another one within a run.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this can't match.
GATES = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9]", "phone": r"\+[0-9]"}
#: Shapes an added token must have, after punctuation at its ends is cut off.
SHAPES = {
    "email": r"^[A-Za-z0-9._%+-]+(@|\(at\)|\[at\])[A-Za-z0-9.-]+$",
    "ip": r"^[0-9A-Fa-f]*[.:][0-9A-Fa-f.:]*[0-9A-Fa-f]$",
    "card": r"^[0-9][0-9-]{10,21}[0-9]$",
    "phone": r"^[+(]?[0-9][0-9().-]{5,17}[0-9]$",
}
#: Candidates of several words, whole.
LONG = {
    "phone": r"(?<![0-9A-Za-z+])\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{2,4}\)[\x20.-]?[0-9]{3,4}[\x20.-][0-9]{3,4}|[0-9]{2,4}[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4})(?![0-9A-Za-z])",
    "card": r"(?<![0-9A-Za-z])[0-9]{4}(?:[\x20-][0-9]{4}){3}(?![0-9A-Za-z])",
}
#: Distinct seeds that a context needs: of both words, of one word, of the form.
LEAST_SEEDS = {"both": 5, "one": 20, "form": 20}
#: Identifier-like: with a digit or an ``@``, or an address whose ``@`` is written out.
TOKEN = r"[^\s]*(?:[0-9@]|\(at\)|\[at\])[^\s]*"
MAYBE = r"[0-9@]|\(at\)|\[at\]"
#: Characters on either side of a span that are looked at for its neighbouring words.
AROUND = 64


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    """Whether the digits of x pass the Luhn check."""
    codes = F.split(F.reverse(_digits(x)), "")
    worth = F.transform(codes, lambda c, i: F.when(i % 2 == 0, c.try_cast("int")).when(c >= "5", c.try_cast("int") * 2 - 9).otherwise(c.try_cast("int") * 2))
    return F.aggregate(worth, F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0))) % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        # A part of more than three digits may have leading zeros only.
        return F.forall(F.split(x, r"\."), lambda p: p.rlike(r"^0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        n = F.length(_digits(x))
        return F.when((n >= 16) & (n <= 19), _luhn(x)).otherwise(False)
    if kind == "phone":
        n = F.length(_digits(x))
        return (n >= 8) & (n <= 15)
    return F.lit(True)


def _checker(kind: str):
    return lambda x: _valid(kind, x)


def _found(text: Column, pattern: str, gate: str, valid) -> Column:
    """Array of (start, end, value) of the matches that pass ``valid``; empty without a match."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["value"])
        one = F.array(F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value")))
        return F.struct(end.alias("at"), F.concat(acc["out"], one).alias("out"))

    placed = lambda m: F.aggregate(F.zip_with(m, F.slice(between, 1, F.size(m)), lambda v, g: F.struct(v.alias("value"), g.alias("gap"))), zero, step)["out"]
    # Gaps are only measured in texts with a match that counts.
    all_of = F.filter(F.transform(F.array(matches), lambda m: F.when(F.exists(m, valid), placed(m)))[0], lambda s: valid(s["value"]))
    hits = F.contains(text, F.lit(gate)) if gate == "@" else text.rlike(gate)
    return F.coalesce(F.when(hits, all_of), F.array().cast("array<struct<start:int,end:int,value:string>>"))


def _key(doc_id: Column, text: Column) -> Column:
    """A name for a document's id and text."""
    return F.xxhash64(doc_id.cast("long"), F.coalesce(text.cast("string"), F.lit("")))


def with_base(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds p_text, p_key (a name for id and text) and one array of spans for each kind."""
    df = docs.withColumn("p_text", F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    df = df.withColumn("p_key", _key(F.col("doc_id"), F.col(text_col)))
    for kind in KINDS:
        df = df.withColumn(f"p_{kind}", _found(F.col("p_text"), PATTERNS[kind], GATES[kind], _checker(kind)))
    return df


def _neighbours(s: Column) -> tuple[Column, Column]:
    """The words before and after the span s of p_text; ``AROUND`` characters on either side hold them, or stand for longer ones."""
    before = F.col("p_text").substr(F.greatest(s["start"] - (AROUND - 1), F.lit(1)), F.least(s["start"], F.lit(AROUND)))
    after = F.col("p_text").substr(s["end"] + 1, F.lit(AROUND))
    return F.lower(F.regexp_extract(before, r"(\S+\s+\S*|\S*)$", 1)), F.lower(F.regexp_extract(after, r"^(\S*\s+\S+|\S*)", 1))


def _fits(kind: str, x: Column) -> Column:
    """Whether an unseen token can be of the kind; what the base rule judges in full and rejects can't."""
    shape = x.rlike(SHAPES[kind])
    if kind in LONG:
        shape = shape | x.rlike(f"^(?:{LONG[kind]})$")
    if kind == "card":
        return shape & ((F.length(_digits(x)) < 16) | _luhn(x))
    if kind == "ip":
        return shape & (~x.rlike(r"^[0-9]+(\.[0-9]+){3}$") | F.when(x.rlike(r"^[0-9]+(\.[0-9]+){3}$"), _valid("ip", x)).otherwise(False))
    return shape


def _with_contexts(tokens: DataFrame) -> DataFrame:
    """A row for each token and context: adds ``level`` and ``context``."""
    sort = lambda c: F.when(F.col(c) == "", "").when(F.col(c).rlike("[0-9@]"), "0").otherwise("a")
    form = F.regexp_replace(F.regexp_replace("value", "[0-9]", "0"), r"\p{L}+", "a")
    word = lambda c: F.when(F.trim(c) != "", F.trim(c))
    ways = [
        ("both", F.xxhash64("left", "right")),
        ("one", F.when(word("left").isNotNull(), F.xxhash64(F.lit("left"), word("left")))),
        ("one", F.when(word("right").isNotNull(), F.xxhash64(F.lit("right"), word("right")))),
        ("form", F.xxhash64(F.lit("form left"), form, sort("left"))),
        ("form", F.xxhash64(F.lit("form right"), form, sort("right"))),
    ]
    every = F.array(*(F.struct(F.lit(level).alias("level"), key.alias("context")) for level, key in ways))
    return tokens.withColumn("w", F.explode(every)).select(*tokens.columns, "w.level", "w.context").where("context is not null")


def trusted_contexts(tokens: DataFrame, rounds: int = 3, least_seeds: dict[str, int] | None = None, least_score: float = 0.9, least_share: float = 0.5) -> DataFrame:
    """(context, kind) of contexts whose instances of the kind's shape are mostly entities of the kind.

    ``tokens(left, right, value, kind, fits)``: kind is null unless the token is a seed; fits has the kinds that an unseen
    token can be of.
    """
    least = F.lit(None).cast("int")
    for level, n in (least_seeds or LEAST_SEEDS).items():
        least = F.when(F.col("level") == level, n).otherwise(least)
    kinds = F.when(F.col("kind").isNotNull(), F.array("kind")).otherwise(F.col("fits"))
    each = _with_contexts(tokens.select("left", "right", "value", "kind", F.explode(kinds).alias("k")))
    edges = each.groupBy("level", "context", "k", "value").agg(F.max(F.col("kind").isNotNull()).alias("seed"), F.count("*").alias("n"))
    seeded = edges.where("seed").groupBy("level", "context", "k").agg(F.count("*").alias("seeds")).where(F.col("seeds") >= least)
    edges = pin(edges.join(seeded.select("context", "k"), ["context", "k"]).select("context", "k", "value", "seed", "n"))
    belief = edges.groupBy("value", "k").agg(F.max(F.col("seed").cast("double")).alias("belief"))
    for _ in range(rounds):
        # A context is worth the weighted mean belief in its instances; an instance the best of its contexts, damped.
        scored = edges.join(belief, ["value", "k"]).groupBy("context", "k").agg(
            (F.sum(F.when(F.col("seed"), 1.0).otherwise(F.col("belief")) * F.log1p("n")) / F.sum(F.log1p("n"))).alias("score"),
            F.avg(F.col("seed").cast("double")).alias("share"),
        )
        belief = edges.join(scored.select("context", "k", "score"), ["context", "k"]).groupBy("value", "k").agg(
            F.max(F.when(F.col("seed"), 1.0).otherwise(F.col("score") * 0.9)).alias("belief")
        )
    return scored.where((F.col("score") >= least_score) & (F.col("share") >= least_share)).select("context", F.col("k").alias("kind"))


def _of_kind(kind: str) -> Column:
    return F.transform(f"p_{kind}", lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))


def _tokens() -> Column:
    """Identifier-like tokens of a ``with_base`` row with their contexts, marked by the kind of the base span they are, or else
    by the kinds that they can be of; tokens that can be of none are left out."""
    spans = F.concat(*(_of_kind(k) for k in KINDS))
    loose = _found(F.col("p_text"), TOKEN, MAYBE, lambda x: F.lit(True))
    long = F.concat(*(_found(F.col("p_text"), LONG[k], GATES[k], lambda x: F.lit(True)) for k in LONG))
    free = lambda of, taken: F.filter(of, lambda t: ~F.exists(taken, lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))

    def trimmed(s: Column) -> Column:
        lead = F.length(F.regexp_extract(s["value"], r"^[\"'(\[{<,;:!?]*", 0))
        inner = F.regexp_replace(F.regexp_replace(s["value"], r"^[\"'(\[{<,;:!?]+", ""), r"[\"')\]}>,;:!?.]+$", "")
        return F.struct(F.lit(None).cast("string").alias("kind"), (s["start"] + lead).alias("start"), (s["start"] + lead + F.length(inner)).alias("end"), inner.alias("value"))

    def placed(s: Column) -> Column:
        left, right = _neighbours(s)
        fits = F.when(s["kind"].isNull(), F.filter(F.array(*(F.when(_fits(k, s["value"]), k) for k in KINDS)), lambda k: k.isNotNull()))
        return F.struct(*(s[c].alias(c) for c in ("kind", "start", "end", "value")), left.alias("left"), right.alias("right"), fits.alias("fits"))

    # Each step is bound to a lambda variable, so that it is made once.
    bind = lambda value, make: F.get(F.transform(F.array(value), make), F.lit(0))
    rest = lambda taken: bind(free(long, taken), lambda wide: F.transform(F.concat(wide, free(free(loose, taken), wide)), trimmed))
    every = bind(spans, lambda taken: F.concat(taken, F.filter(rest(taken), lambda s: s["value"] != "")))
    return F.filter(F.transform(every, placed), lambda t: t["kind"].isNotNull() | (F.size(t["fits"]) > 0))


def extract(docs: DataFrame) -> DataFrame:
    """doc_id, p_key, base spans of each kind, and p_added: array of (kind, start, end) discovered from contexts; no texts.

    Every text is searched once: what the rounds and the result need of it is written, small, to the shared folder.
    """
    tokens = F.when(F.col("p_text").rlike(MAYBE), _tokens())
    base = pin(with_base(docs).select("doc_id", "p_key", *(f"p_{k}" for k in KINDS), tokens.alias("p_tokens")))
    tokens = base.select("p_key", F.explode("p_tokens").alias("t")).select("p_key", "t.*")
    good = trusted_contexts(tokens)
    loose = tokens.where("kind is null").select("p_key", "start", "end", "left", "right", "value", F.explode("fits").alias("kind"))
    added = _with_contexts(loose).join(good, ["context", "kind"])
    added = added.groupBy("p_key").agg(F.sort_array(F.collect_set(F.struct("kind", "start", "end"))).alias("p_added"))
    return base.drop("p_tokens").join(added, "p_key", "left")


def _text_of(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat(F.lit(f"{kind}:"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")))


def _listed(kinds: dict[str, Column]) -> Column:
    return F.array_join(F.concat(*(_text_of(k, spans) for k, spans in kinds.items())), ",")


def all_spans(kind: str) -> Column:
    """Base and added spans of a kind, as an array of (start, end) by start."""
    place = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))
    added = F.coalesce("p_added", F.array().cast("array<struct<kind:string,start:int,end:int>>"))
    added = F.transform(F.filter(added, lambda s: s["kind"] == kind), place)
    return F.array_sort(F.concat(F.transform(f"p_{kind}", place), added))


def report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans. Counts are of base spans."""
    found = extract(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return found.select(
        "doc_id",
        *(F.size(f"p_{k}").cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(_listed({k: F.col(f"p_{k}") for k in KINDS}), 256).alias("base_sha256"),
        _listed({k: all_spans(k) for k in KINDS}).alias("spans"),
    )


#: Up to so many documents with spans, their spans (some hundred bytes each) go to every executor; beyond, the join shuffles.
SMALL = 100_000


def masked(docs: DataFrame) -> DataFrame:
    """The documents, columns as before, with every span replaced by its kind in brackets and n_chars counted anew."""
    spans = F.array_sort(F.concat(*(F.transform(all_spans(k), _named(k)) for k in KINDS)))
    found = extract(docs.select(F.col("doc_id"), F.col("text"))).select("p_key", spans.alias("p_spans"))
    # Rows of one id and text have the same spans.
    found = pin(found.where(F.size("p_spans") > 0).dropDuplicates(["p_key"]))
    rows = docs.select(F.struct(*docs.columns).alias("p_row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("p_text"), _key(F.col("doc_id"), F.col("text")).alias("p_key"))
    rows = rows.join(F.broadcast(found) if found.count() <= SMALL else found.hint("merge"), "p_key", "left")

    def step(acc: Column, s: Column) -> Column:
        # A span inside or across the one before only lengthens it.
        apart = s["start"] >= acc["at"]
        more = F.concat(acc["out"], F.col("p_text").substr(acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["kind"], F.lit("]"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(apart, more).otherwise(acc["out"]).alias("out"))

    def finish(acc: Column) -> Column:
        return F.concat(acc["out"], F.col("p_text").substr(acc["at"] + 1, F.length("p_text")))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    text = F.when(F.col("p_spans").isNull(), F.col("p_row.text")).otherwise(F.aggregate("p_spans", start, step, finish))
    rows = rows.select("p_row", text.alias("p_new"))
    new = {"text": F.col("p_new"), "n_chars": F.length(F.coalesce("p_new", F.lit(""))).cast("long")}
    return rows.select(*(new.get(c, F.col(f"p_row.`{c}`")).alias(c) for c in docs.columns))


def _named(kind: str):
    return lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"))
