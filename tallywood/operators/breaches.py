"""Broken rules of many facts documents at once, as rows.

Every object of a document (root, metric sets, distributions, coverage, candidates,
excerpts, review binding, classification) becomes a row with its path.  Keys are compared
with the object's closed set; rules between numbers are columns; what spans rows (sums over
sources, bounds of a candidate's source, assignments against references) is a join or a
group.  A rule over a value that is absent or of another type is silent: the row that
names that value stands for it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywood.functions.excerpts import with_excerpts
from tallywood.operators import validation as fixed
from tallywood.operators.records import numeric
from tallywood.operators.topics import TOPICS
from tallywood.sources.logs import parsed as strict
from tallywood.sources.staging import spread, staged

# The keys that each object must and may have.
DISTRIBUTION = ("sampleSize", "p50", "p95", "mean", "max")
REQUIRED = {
    "root": ("formatVersion", "generatedAt", "overall", "bySource"), "set": (*fixed.ADDITIVE, "activeDays", "activeMonths", "tokenCoverage", "turnsPerSession", "toolCallsPerSession"),
    "distribution": DISTRIBUTION, "coverage": fixed.COVERAGE, "candidate": ("evidenceRef", "source", "sessionType", "messageCount", "userTurns", "toolCalls", "excerpts"),
    "excerpt": sorted(fixed.EXCERPT_KEYS), "review": sorted(fixed.BINDING_KEYS), "classification": sorted(fixed.CLASSIFICATION_KEYS), "assignment": ("evidenceRef", "source", "primaryTopic"),
}
ALLOWED = REQUIRED | {"root": sorted(fixed.ROOT_KEYS), "set": sorted(fixed.METRIC_KEYS), "candidate": sorted(fixed.CANDIDATE_KEYS)}
TIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]{3})?Z\z"
SHA = r"^[0-9a-f]{64}\z"
REFERENCE = r"^topic-[0-9a-f]{12}-[0-9]{6,}\z"
PARTS = ("turnsPerSession", "toolCallsPerSession", "tokensPerSession")


def _part(o: str, path: str) -> str:
    return f"try_variant_get({o}, '$.{path}', 'variant')"


def _list(o: str, path: str) -> str:
    return f"coalesce(try_variant_get({o}, '$.{path}', 'array<variant>'), cast(array() AS array<variant>))"


def _row(kind_: str, path: str, o: str) -> str:
    return f"named_struct('kind', '{kind_}', 'path', {path}, 'o', {o})"


def objects(docs: DataFrame, kind: str | None = None) -> DataFrame:
    """doc, kind, path and o (variant) of every object of documents (doc, v), or of one kind; what is absent has no row.

    An object carries the names of its whole document, so a kind is read from the documents where it is needed, not written.
    """
    sources = "coalesce(try_variant_get(v, '$.bySource', 'map<string,variant>'), cast(map() AS map<string,variant>))"
    by_source = f"transform(map_entries({sources}), e -> {_row('set', "concat('$.bySource.', e.key)", 'e.value')})"
    below_set = {k: ", ".join(_row(k, f"concat(s.path, '.{p}')", _part("s.o", p)) for p in names) for k, names in (("distribution", PARTS), ("coverage", ("tokenCoverage",)))}
    candidates = f"transform({_list('v', 'representativeCandidates')}, (c, i) -> {_row('candidate', "concat('$.representativeCandidates[', i, ']')", 'c')})"
    excerpts = f"transform({_list('c.o', 'excerpts')}, (x, i) -> {_row('excerpt', "concat(c.path, '.excerpts[', i, ']')", 'x')})"
    every = {
        "root": f"array({_row('root', "'$'", 'v')})", **{k: f"array({_row(k, f"'$.{p}'", _part('v', p))})" for k, p in (("review", "topicReview"), ("classification", "topicClassification"))},
        "set": "sets", **{k: f"flatten(transform(sets, s -> array({rows})))" for k, rows in below_set.items()}, "candidate": "cards", "excerpt": f"flatten(transform(cards, c -> {excerpts}))",
        "assignment": f"transform({_list('v', 'topicClassification.assignments')}, (a, i) -> {_row('assignment', "concat('$.topicClassification.assignments[', i, ']')", 'a')})",
    }
    d = docs.withColumn("sets", F.expr(f"concat(array({_row('set', "'$.overall'", _part('v', 'overall'))}), {by_source})")).withColumn("cards", F.expr(candidates))
    asked = every[kind] if kind else f"concat({', '.join(every.values())})"
    return d.select("doc", F.explode_outer(F.expr(asked)).alias("x")).filter("x.o IS NOT NULL").select("doc", "x.*")


def key_breaches(rows: DataFrame) -> DataFrame:
    """Keys outside of an object's closed set and required keys that it lacks, each under its own path."""
    def of(sets: dict) -> Column:
        return F.create_map(*[x for k, names in sets.items() for x in (F.lit(k), F.array(*map(F.lit, names)))])[F.col("kind")]

    # a key whose value is null is there, as in JSON
    said = rows.withColumn("keys", F.map_keys(F.expr("try_variant_get(o, '$', 'map<string,variant>')")))
    below = lambda rule: lambda k: F.struct(F.concat("path", F.lit("."), k).alias("path"), F.lit(rule).alias("rule"))
    named = F.concat(F.transform(F.array_except("keys", of(ALLOWED)), below("unknown key")), F.transform(F.array_except(of(REQUIRED), "keys"), below("missing key")))
    return _each(said, F.when(F.col("keys").isNull(), F.array(F.struct("path", F.lit("no object").alias("rule")))).otherwise(named))


def _each(rows: DataFrame, found: Column) -> DataFrame:
    """doc, path and rule of each element; an outer explode, as Spark works out the input of a plain one twice to filter by its size."""
    return rows.select("doc", F.explode_outer(found).alias("x")).filter("x IS NOT NULL").select("doc", "x.path", "x.rule")


def _why(rules: dict[str, Column], path: str | Column = "path") -> Column:
    """path and rule of each rule that is false; unknown isn't false."""
    at = F.col(path) if isinstance(path, str) else path
    return F.array_compact(F.array(*[F.when(~ok, F.struct(at.alias("path"), F.lit(rule).alias("rule"))) for rule, ok in rules.items()]))


def _broken(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    return _each(rows, _why(rules))


def _text(path: str) -> Column:
    part = f"try_variant_get(o, '{path}', 'variant')"
    return F.expr(f"if(schema_of_variant({part}) = 'STRING', cast({part} AS string), null)")


def _whole_of(part: str, number: str) -> str:
    """A whole number of at least 0, given a variant and its cast to double: only strings and booleans could be cast as well."""
    return f"if({number} BETWEEN 0 AND 9007199254740991 AND {number} = floor({number}) AND schema_of_variant({part}) NOT IN ('STRING', 'BOOLEAN'), {number}, null)"


def _whole(path: str) -> Column:
    return F.expr(_whole_of(f"try_variant_get(o, '{path}', 'variant')", f"try_variant_get(o, '{path}', 'double')"))


def _is_whole(rows: DataFrame, names) -> DataFrame:
    """Members that are there but aren't whole numbers of at least 0."""
    listed = ", ".join(f"'{k}'" for k in names)
    members = "map_entries(try_variant_get(o, '$', 'map<string,variant>'))"
    bad = F.expr(f"transform(filter({members}, e -> e.key IN ({listed}) AND ({_whole_of('e.value', "try_variant_get(e.value, '$', 'double')")}) IS NULL), e -> concat(path, '.', e.key))")
    return rows.select("doc", F.explode_outer(bad).alias("path"), F.lit("no whole number").alias("rule")).filter("path IS NOT NULL")


NUMBERS = (*fixed.ADDITIVE, "activeDays", "activeMonths", *fixed.TOKENS)


def measured(rows: DataFrame) -> DataFrame:
    """doc, path, source (null for the whole) and the numbers of each metric set, coverage and distributions included.

    Whole numbers are read in one pass over the set's text, as only JSON numbers become doubles.
    """
    below = {"tokenCoverage": [(f"c_{k}", k) for k in fixed.COVERAGE]} | {p: [(f"{p}_{k}", k) for k in DISTRIBUTION if k != "mean"] for p in PARTS}
    members = [f"`{k}` double" for k in NUMBERS] + [f"`{p}` struct<{', '.join(f'`{k}`: double' for _, k in names)}>" for p, names in below.items()]
    said = rows.withColumn("text", F.to_json("o"))
    read = F.when(F.startswith("text", F.lit("{")), F.from_json("text", ", ".join(members), {"allowNonNumericNumbers": "false"}))
    whole = lambda n: F.when(n.between(0, 9007199254740991) & (n == F.floor(n)), n)
    deep = [(name, F.col(f"n.{p}.{k}")) for p, names in below.items() for name, k in names]
    return said.withColumn("n", read).select(
        "doc", "path", F.when(F.col("path") != "$.overall", F.substring("path", len("$.bySource.") + 1, 1 << 30)).alias("source"), "o",
        *[whole(F.col(f"n.{k}")).alias(k) for k in NUMBERS], *[whole(n).alias(name) for name, n in deep],
        *[numeric("o", f"$.{p}.mean").alias(f"{p}_mean") for p in PARTS], *[_text(f"$.{k}").alias(k) for k in ("earliestAt", "latestAt")],
        F.expr(_part("o", "tokensPerSession")).isNotNull().alias("tokens"),
    )


def set_breaches(sets: DataFrame) -> DataFrame:
    """Rules within one metric set and its distributions."""
    c, have = F.col, lambda k: F.col(k).isNotNull()
    given = reduce(lambda a, b: a + b, [have(k).cast("int") for k in fixed.TOKENS])
    span = have("earliestAt") & have("latestAt")
    cover = [c(f"c_{k}") for k in fixed.COVERAGE]
    rules = {
        "messages aren't user + assistant": c("messageCount") == c("userMessageCount") + c("assistantMessageCount"),
        "turns aren't user messages": c("turnCount") == c("userMessageCount"),
        "more recognized than parsed records": c("recognizedRecordCount") <= c("parsedRecordCount"),
        "sessions without a file or a recognized record": (c("sessionCount") == 0) | ((c("fileCount") > 0) & (c("recognizedRecordCount") > 0)),
        "more active months than days": c("activeMonths") <= c("activeDays"),
        "a time of another form": F.coalesce(c("earliestAt").rlike(TIME), F.lit(True)) & F.coalesce(c("latestAt").rlike(TIME), F.lit(True)),
        "half a time range": have("earliestAt") == have("latestAt"),
        "time range and active days disagree": F.when(span, (c("earliestAt") <= c("latestAt")) & (c("activeDays") > 0) & (c("activeMonths") > 0)),
        "active days without a time range": F.when(~span, (c("activeDays") == 0) & (c("activeMonths") == 0)),
        "some token totals are absent": given.isin(0, 3),
        "token totals don't add up": c("totalTokens") == c("inputTokens") + c("outputTokens"),
        "coverage has another session count": cover[0] == c("sessionCount"),
        "coverage out of bounds": (cover[3] <= F.least(cover[1], cover[2])) & (F.greatest(*cover) <= c("sessionCount")),
        "coverage and totals disagree": (cover[3] > 0) == (given == 3),
        "more mismatches than sessions with tokens": c("tokenArithmeticMismatchCount") <= cover[3],
        "token distribution and coverage disagree": (cover[3] > 0) == c("tokens"),
    }
    found = [_why(rules)]
    for p, size, total in ((PARTS[0], c("sessionCount"), c("turnCount")), (PARTS[1], c("sessionCount"), c("toolCallCount")), (PARTS[2], cover[3], c("totalTokens"))):
        n, p50, p95, mean, most = (c(f"{p}_{k}") for k in DISTRIBUTION)
        found.append(_why({
            "another sample size": n == size,
            "values out of order": (p50 <= p95) & (p95 <= most) & (mean <= most),
            "values without a sample": (n > 0) | (F.greatest(p50, p95, mean, most) == 0),
            "mean doesn't fit the total": F.abs(mean * size - total) <= size * 0.005 + 1e-9,
        }, F.concat("path", F.lit(f".{p}"))))
    sizes = [k for k in DISTRIBUTION if k != "mean"]
    told = {"": NUMBERS, "tokenCoverage": fixed.COVERAGE} | dict.fromkeys(PARTS, sizes)
    out = [_each(sets, F.concat(*found))]
    for part, names in told.items():  # what `measured` has read needs no second look
        have_all = [f"c_{k}" if part == "tokenCoverage" else f"{part}_{k}" if part else k for k in names]
        odd = sets.filter(reduce(lambda a, b: a | b, [c(k).isNull() for k in have_all]))
        out.append(_is_whole(odd.select("doc", F.concat("path", F.lit(f".{part}")).alias("path"), F.expr(_part("o", part)).alias("o")) if part else odd, names))
    return reduce(DataFrame.unionAll, out)


def sum_breaches(sets: DataFrame) -> DataFrame:
    """Where the whole isn't the sum, or the range, of the sources."""
    whole, part = F.col("source").isNull(), F.col("source").isNotNull()
    names = {**{k: k for k in (*fixed.ADDITIVE, *fixed.TOKENS)}, **{f"c_{k}": f"tokenCoverage.{k}" for k in fixed.COVERAGE}, "earliestAt": "earliestAt", "latestAt": "latestAt"}
    fold = {"earliestAt": F.min, "latestAt": F.max}
    sides = [F.struct(F.max(F.when(whole, F.col(k))).alias("whole"), fold.get(k, F.sum)(F.when(part, F.col(k))).alias("parts")).alias(k) for k in names]
    grouped = sets.groupBy("doc").agg(*sides)
    wrong = F.array_compact(F.array(*[F.when(~F.col(f"{k}.whole").eqNullSafe(F.col(f"{k}.parts")), F.lit(at)) for k, at in names.items()]))
    return grouped.select("doc", F.explode(F.transform(wrong, lambda k: F.concat(F.lit("$.overall."), k))).alias("path"), F.lit("doesn't follow from the sources").alias("rule"))


def root_breaches(docs: DataFrame, sets: DataFrame) -> DataFrame:
    root, sets = objects(docs, "root"), sets.filter("path <> '$.overall'")
    rules = {
        "another format": _text("$.formatVersion") == "facts.v1", "no time": F.coalesce(_text("$.generatedAt").rlike(TIME), F.lit(False)),
        "too many candidates": F.size(F.expr(_list("o", "representativeCandidates"))) <= fixed.MOST_CANDIDATES,
        "no sources": F.size(F.expr("try_variant_get(o, '$.bySource', 'map<string,variant>')")) > 0,
        "a classification without a review": F.expr(_part("o", "topicClassification")).isNull() | F.expr(_part("o", "topicReview")).isNotNull(),
    }
    return _broken(root, rules).unionAll(_broken(sets, {"unsupported source": F.col("path").isin(*[f"$.bySource.{s}" for s in sorted(fixed.SOURCES)])}))


def candidate_breaches(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """Rules of candidates, against the totals of their source, and of their excerpts."""
    place = F.regexp_extract("path", "([0-9]+)[]]$", 1).cast("int") + 1
    totals = sets.filter("source IS NOT NULL").select("doc", "source", *[F.col(k).alias(f"all_{k}") for k in ("messageCount", "turnCount", "toolCallCount")], F.lit(True).alias("known"))
    tokens = [_whole(f"$.{k}") for k in fixed.TOKENS]
    models = F.expr("try_variant_get(o, '$.models', 'array<string>')")
    roles = F.transform(F.expr(_list("o", "excerpts")), lambda x: F.try_variant_get(x, "$.role", "string"))
    messages, turns, tools = (F.col(k) for k in ("messages", "turns", "tools"))
    rules = {
        "reference out of sequence": _text("$.evidenceRef") == F.concat(F.lit("candidate-"), F.lpad(place.cast("string"), 2, "0")),
        "no user turn": turns > 0, "more turns than messages": turns <= messages,
        "type and tool calls disagree": _text("$.sessionType") == F.when(tools > 0, "agentic").otherwise("conversation"),
        "tokens don't add up": tokens[2] == tokens[0] + tokens[1],
        "an empty list of models": F.size(models) > 0, "ends before it starts": _text("$.startedAt") <= _text("$.endedAt"),
        "bad number of excerpts": F.size(roles).between(1, fixed.MOST_EXCERPTS) & F.array_contains(F.transform(roles, lambda r: F.coalesce(r, F.lit(""))), "user"),
    }
    met = {
        "unknown source": F.coalesce("known", F.lit(False)),
        "more than its source has": (messages <= F.col("all_messageCount")) & (turns <= F.col("all_turnCount")) & (tools <= F.col("all_toolCallCount")),
    }
    numbers = {"messages": _whole("$.messageCount"), "turns": _whole("$.userTurns"), "tools": _whole("$.toolCalls")}
    cards = objects(docs, "candidate").select("doc", "path", _text("$.source").alias("source"), "o", *[n.alias(k) for k, n in numbers.items()])
    cards = cards.select("doc", "path", "source", *numbers, _why(rules).alias("why"))  # no variant goes through a shuffle
    said = objects(docs, "excerpt").select("doc", "path", "o", _text("$.text").alias("text"))
    said = with_excerpts(said, "text", "plain")
    texts = _broken(said, {
        "unknown role": F.coalesce(_text("$.role").isin(*sorted(fixed.ROLES)), F.lit(False)), "unknown position": F.coalesce(_text("$.position").isin(*sorted(fixed.POSITIONS)), F.lit(False)),
        "a longer text": F.length("text") <= fixed.EXCERPT_POINTS, "isn't normalized": F.col("text") == F.coalesce("plain", F.lit("")),
    })
    counted = _is_whole(objects(docs, "candidate"), ("messageCount", "userTurns", "toolCalls", *fixed.TOKENS))
    return _each(cards.join(totals, ["doc", "source"], "left"), F.concat("why", _why(met))).unionAll(texts).unionAll(counted)


def topic_breaches(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """Rules of the review's binding and of the classification; references meet assignments by place, sources and topics by groups."""
    review = objects(docs, "review").select("doc", "path", _text("$.populationSha256").alias("sha"), _text("$.formatVersion").alias("format"), _whole("$.sessionCount").alias("sessions"))
    done = objects(docs, "classification")
    closing = done.select("doc", "path", *[_text(f"$.{k}").alias(k) for k in ("method", "taxonomyVersion", "populationSha256")], *[_whole(f"$.{k}").alias(k) for k in ("denominator", "reviewedSessionCount")])
    whole = sets.filter("source IS NULL").select("doc", F.col("sessionCount").alias("n"))
    refs = docs.select("doc", F.posexplode(F.expr("try_variant_get(v, '$.topicReview.evidenceRefs', 'array<string>')")).alias("pos", "ref"))
    refs = staged(refs, "references")
    many = refs.groupBy("doc").agg(F.count("*").alias("refs"))
    out = [_broken(review.join(whole, "doc").join(many, "doc", "left"), {
        "another format": F.col("format") == "topic-review.v1", "no hash": F.coalesce(F.col("sha").rlike(SHA), F.lit(False)),
        "another session count": (F.col("sessions") == F.col("n")) & (F.coalesce("refs", F.lit(0)) == F.col("n")),
    })]
    at = F.concat(F.lit("$.topicReview.evidenceRefs["), "pos", F.lit("]"))
    out.append(_broken(refs.withColumn("path", at), {"a reference of another form": F.coalesce(F.col("ref").rlike(REFERENCE), F.lit(False))}))
    again = refs.groupBy("doc", "ref").agg(F.count("*").alias("times")).filter("times > 1")
    out.append(again.select("doc", F.concat(F.lit("$.topicReview.evidenceRefs: "), "ref").alias("path"), F.lit("doubled reference").alias("rule")))
    given = docs.select("doc", F.posexplode(F.expr("try_variant_get(v, '$.topicClassification.assignments', 'array<variant>')")).alias("pos", "o"))
    given = staged(given.select("doc", "pos", _text("$.evidenceRef").alias("said"), _text("$.source").alias("source"), _text("$.primaryTopic").alias("topic")), "assignments")
    met = given.join(refs.join(done.select("doc"), "doc"), ["doc", "pos"], "full").withColumn("path", F.concat(F.lit("$.topicClassification.assignments["), "pos", F.lit("]")))
    out.append(_broken(met, {"another session than the review's": F.coalesce(F.col("said") == F.col("ref"), F.lit(False))}))
    out.append(_broken(given.withColumn("path", F.concat(F.lit("$.topicClassification.assignments["), "pos", F.lit("]"))), {"unknown topic": F.coalesce(F.col("topic").isin(*TOPICS), F.lit(False))}))
    size = given.groupBy("doc").agg(F.count("*").alias("given"))
    bound = review.select("doc", "sha")
    out.append(_broken(closing.join(size, "doc", "left").join(bound, "doc", "left"), {
        "another method or taxonomy": (F.col("method") == fixed.METHOD) & (F.col("taxonomyVersion") == fixed.TAXONOMY), "another hash than the review's": F.col("populationSha256") == F.col("sha"),
        "another number of sessions": (F.col("denominator") == F.coalesce("given", F.lit(0))) & (F.col("reviewedSessionCount") == F.coalesce("given", F.lit(0))),
    }))
    told = done.select("doc", F.explode(F.expr("try_variant_get(o, '$.counts', 'map<string,bigint>')")).alias("topic", "told"))
    every = done.select("doc", F.explode(F.array(*map(F.lit, TOPICS))).alias("topic"))
    counted = every.join(given.groupBy("doc", "topic").agg(F.count("*").alias("n")), ["doc", "topic"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    out.append(_broken(counted.join(told, ["doc", "topic"], "full").withColumn("path", F.concat(F.lit("$.topicClassification.counts."), "topic")), {"doesn't follow from the assignments": F.col("n").eqNullSafe(F.col("told"))}))
    by_source = sets.filter("source IS NOT NULL").join(done.select("doc"), "doc").select("doc", "source", F.col("sessionCount").alias("n"))
    mine = given.groupBy("doc", "source").agg(F.count("*").alias("mine"))
    out.append(_broken(by_source.join(mine, ["doc", "source"], "full").withColumn("path", F.concat(F.lit("$.bySource."), "source")), {"another number of assignments than sessions": F.coalesce("n", F.lit(0)) == F.coalesce("mine", F.lit(0))}))
    return reduce(DataFrame.unionAll, out)


def breaches(docs: DataFrame) -> DataFrame:
    """doc, path and rule of every broken rule of facts documents (doc, json); text that is no JSON object breaks one rule, `no object` at $.

    doc must name a document once.  A null text is no object; an empty table has no rows.
    """
    v = F.when(F.col("json").rlike("^[ \\t\\r\\n]*\\{"), strict("json"))
    parsed = staged(spread(docs).select("doc", v.alias("v")), "facts")
    good = parsed.filter("v IS NOT NULL")
    sets = staged(measured(objects(good, "set")), "sets")
    none = parsed.filter("v IS NULL").select("doc", F.lit("$").alias("path"), F.lit("no object").alias("rule"))
    found = [none, key_breaches(objects(good)), root_breaches(good, sets), set_breaches(sets), sum_breaches(sets), candidate_breaches(good, sets), topic_breaches(good, sets)]
    return reduce(DataFrame.unionAll, found)
