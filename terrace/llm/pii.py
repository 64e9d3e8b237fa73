"""Personal data by bootstrapped contextual extraction (native).

Base patterns find emails, ip addresses, card and phone numbers. They seed the bootstrap: every
identifier-like run of tokens (with a digit or an @) is an instance, without the punctuation that
encloses it, the words around it are its lexical patterns; a run that is no identifier as a whole is
parted into those it lists. Two rounds score the graph of patterns and instances: of what a pattern
extracts, trusted instances speak for it and those that cannot be of the kind against it; those that
may be, but are not known yet, are what the method looks for, and do neither. An instance is trusted
if it is a seed or good patterns agree on it. Runs that good patterns extract, that look like their kind and overlap no base span, are added.

Scores are joins and aggregations of edges counted by (pattern, instance), so a word that stands
before a third of all numbers is as cheap as any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrace.llm.shared import read, stored

KINDS = ("email", "ip", "card", "phone")
#: The base patterns, written so that Java's matcher reads a run once: possessive where nothing
#: can be given back, and never begun inside a run whose beginning has failed.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a kind to be looked for.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: Runs of tokens with a digit or an @, one white space between them.
RUN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+(?:\s[^\s0-9@]*+[0-9@]\S*+)*+"
CONTEXT = 48
#: What \s stands for in Java's patterns.
WHITE = " \t\n\x0b\f\r"
#: Matches whose places are summed up together: the work of a text with n matches is n * BLOCK at most.
BLOCK = 512
SPANS = "array<struct<start:int,end:int,found:string>>"
#: What a discovered run must look like to be of a kind.
FORM = {
    "email": r"^[^@\s]+@[^@\s]+$",
    "ip": r"^[0-9A-Fa-f]{1,4}(?:[.:\[\]()-]+[0-9A-Fa-f]{1,4}){3,7}$",
    "card": r"^(?:[0-9Xx*][ .-]?){11,18}[0-9Xx*]$",
    "phone": r"^[+(]?[0-9](?:[ ()./-]*[0-9]){8,14}$",
}
#: Punctuation that may enclose an identifier, but for round brackets, and what parts a list (not an area code's bracket).
ENCLOSING = "\"'`<>[]{}|*,;:.!?…«»“”„‘’‹›"
PARTED_AFTER, PARTED_BEFORE = "(?:[\"'`>\\]}|,;:.!?…»”’›]|(?<!^\\([0-9]{1,9})\\))$", "^[\"'`<\\[{|«“„‘‹]"


def _spans(text: Column, pattern: str) -> Column:
    """array<struct<start, end, found>> of a pattern's matches, leftmost and non-overlapping, in code points.

    The gaps between matches come from split, their lengths and the matches' give the places."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    steps = F.zip_with(found, gaps, lambda m, g: F.struct(m.alias("m"), F.length(g).alias("g")))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / BLOCK).cast("int")), lambda b: F.slice(steps, b * BLOCK + 1, F.lit(BLOCK)))

    def follow(acc: Column, block: Column) -> Column:
        length = F.aggregate(block, F.lit(0), lambda n, step: n + F.coalesce(step["g"], F.lit(0)) + F.coalesce(F.length(step["m"]), F.lit(0)))
        return F.struct((acc["at"] + length).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    def add(acc: Column, step: Column) -> Column:
        begin = acc["at"] + F.coalesce(step["g"], F.lit(0))
        end = begin + F.length(step["m"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), step["m"].alias("found")))).alias("out"))

    begins = F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), follow)["out"]
    placed = F.zip_with(blocks, begins, lambda block, at: F.aggregate(block, F.struct(at.alias("at"), F.array().cast(SPANS).alias("out")), add)["out"])
    return F.when(F.size(found) > 0, F.filter(F.flatten(placed), lambda s: s["found"].isNotNull())).otherwise(F.array().cast(SPANS))


def _valid(kind: str, found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(found, r"\."), lambda part: _small(F.ltrim(part, F.lit("0"))))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.length(digits).between(12, 19) & (_luhn(digits) % 10 == 0)


def _small(part: Column) -> Column:
    """At most 255; the part has no leading zeros left."""
    return (F.length(part) <= 3) & (F.coalesce(part.try_cast("int"), F.lit(0)) <= 255)


def _luhn(digits: Column) -> Column:
    """Sum of Luhn; the second, fourth ... digit from the right counts twice, less 9 beyond 9."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.struct(F.coalesce(d.try_cast("int"), F.lit(0)).alias("d"), (i % 2).alias("odd")))
    return F.aggregate(each, F.lit(0), lambda acc, x: acc + F.when(x["odd"] == 0, x["d"]).when(x["d"] > 4, 2 * x["d"] - 9).otherwise(2 * x["d"]))


def base_spans(text: Column, kind: str) -> Column:
    """array<struct<start, end, found>> of a kind's base spans; failing matches are left out."""
    t = F.coalesce(text, F.lit(""))
    there = F.contains(t, F.lit(NEEDS[kind])) if NEEDS[kind] else t.rlike("[0-9]")
    candidates = F.filter(_spans(t, BASE[kind]), lambda s: _valid(kind, s["found"]))
    return F.when(there, candidates).otherwise(F.array().cast(SPANS))


def with_base(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds a column for each kind with its base spans."""
    return docs.withColumns({kind: base_spans(F.col(text), kind) for kind in KINDS})


def _formed(found: Column) -> Column:
    return found.rlike("|".join(f"(?:{form})" for form in FORM.values()))


def _core(piece: Column) -> Column:
    """struct<start, end, found> of a piece (the same) without enclosing punctuation. A round bracket
    goes if it has no partner in the piece, or if the pair encloses the whole."""

    def bare(p: Column) -> Column:
        tail = F.ltrim(p["found"], F.lit(ENCLOSING))
        begin = p["start"] + F.length(p["found"]) - F.length(tail)
        found = F.rtrim(tail, F.lit(ENCLOSING))
        return F.struct(begin.alias("start"), (begin + F.length(found)).alias("end"), found.alias("found"))

    def unbracketed(p: Column) -> Column:
        found, n = p["found"], F.length(p["found"])
        more = F.length(F.replace(found, F.lit(")"), F.lit(""))) - F.length(F.replace(found, F.lit("("), F.lit("")))
        whole = found.rlike(r"^\([^()]*\)$")
        first = (F.startswith(found, F.lit("(")) & ((more > 0) | whole)).cast("int")
        last = (F.endswith(found, F.lit(")")) & ((more < 0) | whole)).cast("int")
        return F.struct((p["start"] + first).alias("start"), (p["end"] - last).alias("end"), F.substring(found, first + 1, n - first - last).alias("found"))

    out = F.array(bare(piece))
    for step in (unbracketed, bare, unbracketed, bare):
        out = F.transform(out, step)
    return F.get(out, F.lit(0))


def _listed(runs: DataFrame) -> DataFrame:
    """run and core of the identifiers that runs list: those that hold a base span or are none as a whole.

    Tokens that overlap a base span are left out. Stretches of the others, ending at base spans and
    at punctuation, are offered whole if they have a form, else the tokens that have one.
    """
    several = runs.filter(F.col("found").rlike(r"\s") & ((F.size("seeds") > 0) | ~_formed(F.col("core.found"))))
    tokens = several.select("run", "start", "bases", F.posexplode(_spans(F.col("found"), r"\S++")).alias("at", "t"))
    clear = ~F.exists("bases", lambda b: (b["start"] < F.col("t")["end"]) & (F.col("t")["start"] < b["end"]))
    tokens = tokens.select("run", "at", "start", "t", clear.alias("clear"))
    order = Window.partitionBy("run").orderBy("at")
    ends = ~F.col("clear") | F.col("t.found").rlike(PARTED_AFTER)
    begins = F.coalesce(F.lag(ends).over(order), F.lit(False)) | F.col("t.found").rlike(PARTED_BEFORE)
    numbered = tokens.withColumn("begins", begins.cast("int")).withColumn("stretch", F.sum("begins").over(order)).filter("clear")
    token = F.struct((F.col("start") + F.col("t.start")).alias("start"), (F.col("start") + F.col("t.end")).alias("end"), F.col("t.found").alias("found"))
    stretches = numbered.groupBy("run", "stretch").agg(F.array_sort(F.collect_list(token)).alias("tokens"))
    first, last = F.get("tokens", F.lit(0))["start"], F.element_at("tokens", -1)["end"]
    # One white space stands between the tokens of a run.
    whole = _core(F.struct(first.alias("start"), last.alias("end"), F.array_join(F.col("tokens.found"), " ").alias("found")))
    parts = F.filter(F.transform("tokens", _core), lambda p: _formed(p["found"]))
    return stretches.withColumn("whole", whole).select("run", F.explode(F.when(_formed(F.col("whole.found")), F.array("whole")).otherwise(parts)).alias("core"))


def candidates(runs: DataFrame) -> DataFrame:
    """Instances of the runs: __row, start, end, found, left, right, seeds and weight, their share in
    their run's one vote. Identifiers that a run lists stand between the words around the run; they
    share its vote, or have none where the run holds a seed."""
    listed = stored(_listed(runs), "listed")
    parts = listed.groupBy("run").agg(F.count("*").alias("parts"))
    whole = runs.join(parts, "run", "left").withColumn("weight", F.when(F.col("parts").isNull() | (F.size("seeds") > 0), 1.0).otherwise(0.0)).filter("weight > 0")
    told = runs.join(parts, "run").select("run", "__row", "left", "right", F.when(F.size("seeds") > 0, 0.0).otherwise(1 / F.col("parts")).alias("weight"))
    pieces = listed.join(told, "run").withColumn("seeds", F.array().cast("array<string>"))
    columns = ["__row", "core.start", "core.end", "core.found", "left", "right", "seeds", "weight"]
    return whole.select(*columns).unionByName(pieces.select(*columns))


def instances(keyed: DataFrame, text: str = "text") -> DataFrame:
    """Identifier-like runs: their number, __row, start, end, found, left and right word, the kinds they
    seed, the base spans in them, and core, their span and text without enclosing punctuation.

    The words are the nearest ones between the run and its neighbours, however wide the space; of
    a longer word the CONTEXT characters nearest to the run stand for it.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    gaps = F.split(t, RUN, -1)
    runs = keyed.select("__row", gaps.alias("gaps"), F.posexplode(_spans(t, RUN)).alias("k", "run")).select(
        "__row",
        "run.*",
        F.regexp_extract(F.right(F.rtrim(F.get("gaps", F.col("k")), F.lit(WHITE)), F.lit(CONTEXT)), r"(\S+)$", 1).alias("left"),
        F.regexp_extract(F.left(F.ltrim(F.get("gaps", F.col("k") + 1), F.lit(WHITE)), F.lit(CONTEXT)), r"^(\S+)", 1).alias("right"),
    )
    spans = runs.withColumns({f"__{k}": base_spans(F.col("found"), k) for k in KINDS})
    seeds = F.array_compact(F.array(*[F.when(F.size(f"__{k}") > 0, F.lit(k)) for k in KINDS]))
    bases = F.transform(F.concat(*[f"__{k}" for k in KINDS]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    core = _core(F.struct("start", "end", "found"))
    return spans.select(F.monotonically_increasing_id().alias("run"), *runs.columns, seeds.alias("seeds"), bases.alias("bases"), core.alias("core"))


def _patterns(runs: DataFrame) -> DataFrame:
    """Edges before counting: each run under its left word, its right word and both, as far as it has them."""
    left, right = F.lower("left"), F.lower("right")
    before, after = F.col("left") != "", F.col("right") != ""
    names = F.array(F.when(before, F.concat(F.lit("l "), left)), F.when(after, F.concat(F.lit("r "), right)), F.when(before & after, F.concat_ws(" ", F.lit("b"), left, right)))
    return runs.withColumn("pattern", F.explode(F.array_compact(names)))


def discovered(keyed: DataFrame, text: str = "text", rounds: int = 2, least: int = 5, trust: float = 0.9) -> DataFrame:
    """(__row, kind, start, end) of runs that the bootstrap finds: not seeds themselves.

    A pattern is used for a kind if at least `least` different trusted instances stand in it and
    their share reaches `trust` among the runs that are trusted or lack the kind's form; a run is found if the patterns around it reach
    that together (1 - the product of their misses) and it has the kind's form.
    """
    runs = stored(candidates(stored(instances(keyed, text), "runs")), "candidates")
    edges = _patterns(runs).groupBy("pattern", F.md5(F.lower("found")).alias("instance")).agg(F.sum("weight").alias("n"), F.max("seeds").alias("seeds"), F.max("found").alias("found"))
    edges = stored(edges, "edges")
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.array_contains("seeds", k).alias("seed"), F.col("found").rlike(FORM[k]).alias("form")) for k in KINDS])
    graph = edges.select("pattern", "instance", "n", F.explode(kinds).alias("k")).select("pattern", "instance", "n", "k.*")
    trusted = graph.filter("seed").select("instance", "kind").distinct()
    against = graph.filter("not form and not seed").groupBy("pattern", "kind").agg(F.sum("n").alias("miss"))
    good = confidence = None
    for _ in range(rounds):
        hits = graph.join(trusted, ["instance", "kind"]).groupBy("pattern", "kind").agg(F.sum("n").alias("hit"), F.count_if(F.col("n") > 0).alias("support")).filter(F.col("support") >= least)
        told = hits.join(against, ["pattern", "kind"], "left").withColumn("share", F.col("hit") / (F.col("hit") + F.coalesce("miss", F.lit(0.0))))
        good = stored(told.filter(F.col("share") >= trust).select("pattern", "kind", "share"), "patterns")
        reach = graph.filter("form and not seed").join(good, ["pattern", "kind"])
        confidence = stored(reach.groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.least("share", F.lit(0.999999)))))).alias("confidence")).filter(F.col("confidence") >= trust), "instances")
        trusted = trusted.unionByName(confidence.select("instance", "kind")).distinct()
    there = _patterns(runs.filter(F.size("seeds") == 0)).withColumn("instance", F.md5(F.lower("found")))
    found = there.join(confidence.select("instance", "kind"), "instance").join(good.select("pattern", "kind"), ["pattern", "kind"])
    return found.select("__row", "kind", "start", "end").distinct()


def extract(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **bootstrap) -> DataFrame:
    """Adds email, ip, card and phone (base spans: start, end, found), base and spans, all spans with
    their kind in order of start, then kind.

    Null texts count as empty and have none. Repeated rows share what is found. Other columns stay,
    whatever their names; columns of the added names are replaced. An empty table gives no rows.
    """
    kept = [c for c in docs.columns if c not in (*KINDS, "base", "spans")]
    row = F.xxhash64(F.col(doc_id), F.col(text)).alias("__row")
    keyed = docs.select(F.struct(*kept).alias("__doc"), row, F.col(text).alias("__text"))
    more = discovered(docs.select(row, F.col(text).alias("text")), **bootstrap)
    more = more.groupBy("__row").agg(F.collect_list(F.struct("start", "end", "kind")).alias("__more"))
    base = with_base(keyed, "__text").join(more, "__row", "left")
    named = F.concat(*[_ranked(kind, i) for i, kind in enumerate(KINDS)])
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    added = F.filter(
        F.transform(F.coalesce("__more", F.array().cast("array<struct<start:int,end:int,kind:string>>")), lambda m: F.struct(m["start"].alias("start"), rank[m["kind"]].alias("rank"), m["end"].alias("end"))),
        lambda m: ~F.exists("__base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])),
    )
    found = base.withColumn("__base", F.array_sort(named)).withColumn("__all", F.array_sort(F.concat("__base", added)))
    return found.select("__doc.*", *KINDS, F.col("__base").alias("base"), F.col("__all").alias("spans"))


def _ranked(kind: str, rank: int) -> Column:
    return F.transform(F.col(kind), lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end")))


def _joined(spans: Column) -> Column:
    kind = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kind, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row of documents: doc_id, the counts of base spans by kind, the digest of the base spans, and
    all spans, those that the bootstrap adds among them."""
    found = extract(read(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
