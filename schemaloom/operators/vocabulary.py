"""The controlled vocabulary: matching, merging, hygiene and enrichment.

A vocabulary is metadata: terms (name, description, synonyms, sources, pos), mappings (attribute, canonical, confidence,
rationale, seq) and entity mappings (source_entity, canonical, confidence, rationale, seq), some rows for each column of a
model. What rules say of rows or groups is DataFrame work. Where one decision changes what the next is compared with, Spark
computes the facts of all pairs first, and the decisions are gone through in the model's order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from schemaloom.functions import values as V
from schemaloom.functions.names import MEASURE, TEMPORAL, attribute_part, bare_key, distinct_by, distinct_ignoring_case, entity_label, entity_part, has_any, qualified_key, term, tokens
from schemaloom.functions.similarity import hybrid, jaccard
from schemaloom.operators.common import checkpointed, fresh
from schemaloom.operators.profile import categories, kind_shares

#: Least scores for reusing a term or an entity, and what new ones count.
TERM, ENTITY, NEW_TERM, NEW_ENTITY = 0.65, 0.6, 0.75, 0.8
#: Confidence of an attribute or entity that was filled in: by votes or reuse, by name, by synonym or tokens, as new.
FILLED, FILLED_ENTITY, TOKENS = (0.75, 0.7, 0.68, 0.55), (0.86, 0.74, 0.68, 0.58), 0.6


def _first(df: DataFrame, key: list, order: list) -> DataFrame:
    """The row of each key that comes first; a partial aggregation, so no key's rows gather."""
    row = F.min_by(F.struct(*[F.col(c) for c in df.columns]), F.struct(*order))
    return df.groupBy(*[k.alias(f"key{i}") for i, k in enumerate(key)]).agg(row.alias("row")).select("row.*")


def _surest(mappings: DataFrame, name: str) -> DataFrame:
    reason = (F.coalesce("rationale", F.lit("")) != "").cast("int")
    row = F.max_by(F.struct(*mappings.columns), F.struct(F.coalesce("confidence", F.lit(-1.0)), reason, "seq"))
    return mappings.groupBy(qualified_key(name).alias("key")).agg(row.alias("row"), F.min("seq").alias("first")).filter("key <> ''")


def best_mappings(mappings: DataFrame, name: str = "attribute") -> DataFrame:
    """One mapping for each attribute (canonical, confidence, rationale, seq): the surest, then one with a rationale, then the latest. A null confidence counts least."""
    return _surest(mappings, name).select("row.*")


def deduplicated(mappings: DataFrame, name: str = "attribute") -> DataFrame:
    """``best_mappings``, in the order in which their attributes came first: that is their seq."""
    return _surest(mappings, name).select(*[F.col("first" if c == "seq" else f"row.{c}").alias(c) for c in mappings.columns])


def carried_forward(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Both, the existing ones first: seq goes on from the existing."""
    last = fresh("last", existing, new)
    after = existing.agg(F.coalesce(F.max("seq") + 1, F.lit(0)).alias(last))  # one row
    return existing.unionByName(new.crossJoin(F.broadcast(after)).withColumn("seq", F.col("seq") + F.col(last)).drop(last))


def _shown_as(mappings: DataFrame, column: str, key: Column, known: DataFrame) -> DataFrame:
    """mappings whose key is one of known (key, shown), with ``column`` as shown; all other columns are kept, whatever their names."""
    k, shown = fresh("key", mappings), fresh("shown", mappings)
    once_ = known.groupBy(F.col("key").alias(k)).agg(F.min("shown").alias(shown))
    return mappings.withColumn(k, key).join(once_, k).withColumn(column, F.col(shown)).select(*[F.col(f"`{c}`") for c in mappings.columns])


def valid_mappings(mappings: DataFrame, attributes: DataFrame) -> DataFrame:
    """Mappings whose attribute the model (entity, attr) still has, spelled as the model does."""
    shown = F.concat_ws(".", "entity", "attr")
    return _shown_as(mappings, "attribute", qualified_key("attribute"), attributes.select(qualified_key(shown).alias("key"), shown.alias("shown")))


def valid_entity_mappings(mappings: DataFrame, entities: DataFrame) -> DataFrame:
    """Entity mappings whose entity the model still has, spelled as the model does, their canonical name in display form."""
    known = entities.select(bare_key("entity").alias("key"), F.col("entity").alias("shown"))
    return _shown_as(mappings, "source_entity", bare_key("source_entity"), known).withColumn("canonical", entity_label("canonical"))


def archive(terms: DataFrame, mappings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, archived) terms: those that a mapping uses or that have sources, and the others; all columns of terms are kept, whatever their names."""
    key, mark = fresh("key", terms), fresh("used", terms)
    used = mappings.select(bare_key("canonical").alias(key)).distinct().withColumn(mark, F.lit(True))
    sourced = F.exists("sources", lambda x: qualified_key(x) != "") if "sources" in terms.columns else F.lit(False)
    both = terms.withColumn(key, bare_key("name")).join(used, key, "left").withColumn(mark, F.coalesce(mark, F.lit(False)) | F.coalesce(sourced, F.lit(False)))
    every = [F.col(f"`{c}`") for c in terms.columns]
    return both.filter(F.col(mark)).select(*every), both.filter(~F.col(mark)).select(*every)


def stale_sources(terms: DataFrame, attributes: DataFrame) -> DataFrame:
    """terms without sources that the model lacks; all other columns are kept, whatever their names."""
    kept, name = fresh("kept", terms), fresh("name_", terms)
    known = attributes.select(qualified_key(F.concat_ws(".", "entity", "attr")).alias("key")).distinct()
    held = terms.select("name", F.posexplode("sources").alias("place", "source")).withColumn("key", qualified_key("source")).join(known, "key", "left_semi")
    left = held.groupBy(F.col("name").alias(name)).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "source"))), lambda x: x["source"]).alias(kept))
    both = terms.join(left, F.col("name") == F.col(name), "left").withColumn("sources", F.coalesce(kept, F.array().cast("array<string>")))
    return both.select(*[F.col(f"`{c}`") for c in terms.columns])


def names_of(terms: DataFrame) -> DataFrame:
    """(key, name): every name and synonym; a name beats a synonym, then the first term wins."""
    every = terms.select(F.lower("name").alias("key"), F.lit(0).alias("by"), "pos", "name").union(terms.select(F.explode(F.transform("synonyms", F.lower)).alias("key"), F.lit(1), "pos", "name"))
    return _first(every, [F.col("key")], [F.col("by"), F.col("pos")]).select("key", "name")


def _longest(rows: Column) -> Column:
    """The first of the longest descriptions."""
    size = lambda x: F.length(F.coalesce(x, F.lit("")))
    return F.aggregate(rows, F.get(rows, 0)["description"], lambda best, r: F.when(size(r["description"]) > size(best), r["description"]).otherwise(best))


def _synonyms(values: Column, name: Column) -> Column:
    """Without empty ones and the name itself, the first spelling of each."""
    return distinct_ignoring_case(F.filter(values, lambda v: (v != "") & (F.lower(v) != F.lower(name))))


def joined_names(existing: DataFrame, new: DataFrame) -> DataFrame:
    """(key, target): for each new term's name, in lower case, the name of the existing term that it joins.

    That is the term which has the name as its name or as a synonym; where several have it, the last of them.
    """
    spelled = existing.select("name", "pos", F.posexplode(F.concat("synonyms", F.array("name"))).alias("place", "key"))
    index = spelled.groupBy(F.lower("key").alias("key")).agg(F.max_by("name", F.struct("pos", "place")).alias("target"))
    return new.select(F.lower("name").alias("key")).distinct().join(index, "key")


def merge_terms(existing: DataFrame, new: DataFrame) -> DataFrame:
    """(name, description, synonyms, sources, pos): a new term joins the existing one that has its name as name or synonym.

    The joined term's name becomes a synonym, the longer description wins, the sources are those of the newest term alone.
    """
    once = new.groupBy(F.lower("name").alias("key")).agg(F.max_by(F.struct("name", "description", "synonyms", "sources"), "pos").alias("row"), F.min("pos").alias("pos")).select("key", "row.*", "pos")
    last = existing.agg(F.coalesce(F.max("pos") + 1, F.lit(0)).alias("last"))
    moved = once.join(joined_names(existing, new), "key", "left").crossJoin(F.broadcast(last)).withColumn("key", F.coalesce(F.lower("target"), "key"))
    fields = ["name", "description", "synonyms", "sources"]
    both = existing.select(F.lower("name").alias("key"), F.col("pos").alias("at"), *fields).union(moved.select("key", F.col("pos") + F.col("last"), *fields))
    grouped = both.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("at", *fields))).alias("rows"))
    name = F.get("rows", 0)["name"]
    more = F.flatten(F.transform("rows", lambda r, i: F.when(i > 0, F.concat(F.array(r["name"]), r["synonyms"])).otherwise(r["synonyms"])))
    return grouped.select(name.alias("name"), _longest(F.col("rows")).alias("description"), _synonyms(more, name).alias("synonyms"), F.element_at("rows", -1)["sources"].alias("sources"), F.get("rows", 0)["at"].alias("pos"))


def remapped(mappings: DataFrame, terms: DataFrame) -> DataFrame:
    """mappings with canonical names as the terms spell them, also where a synonym was used."""
    return mappings.join(names_of(terms), F.lower("canonical") == F.col("key"), "left").withColumn("canonical", F.coalesce("name", "canonical")).drop("key", "name")


def _repaired(df: DataFrame, column: str, attributes: DataFrame) -> DataFrame:
    """df with qualified attributes whose entity the model lacks moved to an entity that has the attribute: one that spells it so, else the first."""
    entities = attributes.select(F.col("entity").alias("prefix")).distinct().withColumn("known", F.lit(True))
    first = F.min_by("entity", F.struct("epos", "apos"))
    exact = attributes.groupBy(F.col("attr").alias("suffix")).agg(first.alias("exact"))
    loose = attributes.groupBy(F.lower("attr").alias("low")).agg(first.alias("loose"))
    keyed = df.withColumns({"prefix": F.when(F.contains(F.col(column), F.lit(".")), F.substring_index(column, ".", 1)), "suffix": attribute_part(column)}).withColumn("low", F.lower("suffix"))
    both = keyed.join(entities, "prefix", "left").join(exact, "suffix", "left").join(loose, "low", "left")
    moved = F.concat_ws(".", F.coalesce("exact", "loose"), "suffix")
    fixed = F.when(F.col("prefix").isNotNull() & F.col("known").isNull() & F.col("loose").isNotNull(), moved).otherwise(F.col(column))
    return both.withColumn(column, fixed).select(*df.columns)


def repaired_prefixes(mappings: DataFrame, attributes: DataFrame) -> DataFrame:
    """mappings whose attribute names an entity that the model lacks get an entity that holds such an attribute, if there is one."""
    return _repaired(mappings, "attribute", attributes)


def repaired_sources(terms: DataFrame, attributes: DataFrame) -> DataFrame:
    """The same for the sources of terms."""
    each = _repaired(terms.select("pos", F.posexplode("sources").alias("place", "source")), "source", attributes)
    again = each.groupBy("pos").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "source"))), lambda x: x["source"]).alias("fixed"))
    return terms.join(again, "pos", "left").withColumn("sources", F.coalesce("fixed", F.array().cast("array<string>"))).select(*terms.columns)


def abstract_name(name: Column, sources: Column) -> Column:
    """name as a term, without two or more leading words that all source entities share and no source attribute needs.

    An attribute needs its words that are not words of its entity, or all if there are no others.
    """
    facts = lambda s: F.struct(F.coalesce(entity_part(s), F.lit("")).alias("entity"), tokens(entity_part(s)).alias("e"), tokens(attribute_part(s)).alias("a"))
    parts = F.filter(F.transform(sources, facts), lambda p: (p["entity"] != "") & (F.size(p["a"]) > 0))
    return once(tokens(name), lambda words: once(parts, lambda parts: _shortened(name, words, parts)))


def once(value: Column, use) -> Column:
    """use(value) with value bound as a lambda's argument: it stands in the expression once, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def _shortened(name: Column, words: Column, parts: Column) -> Column:
    shared = F.aggregate(parts, words, lambda acc, p: F.array_intersect(acc, p["e"]))
    needed = F.flatten(F.transform(parts, lambda p: F.when(F.size(F.array_except(p["a"], p["e"])) > 0, F.array_except(p["a"], p["e"])).otherwise(p["a"])))
    loose = F.transform(words, lambda w: F.array_contains(shared, w) & ~F.array_contains(needed, w))
    lead = F.coalesce(F.nullif(F.array_position(loose, F.lit(False)).cast("int"), F.lit(0)) - 1, F.size(words))
    rest = once(lead, lambda n: F.when((F.size(parts) > 0) & (n >= 2) & (n < F.size(words)), F.slice(words, n + 1, F.size(words) - n)).otherwise(words))
    return F.when(F.size(words) == 0, name).otherwise(term(rest))


def abstracted(terms: DataFrame) -> DataFrame:
    """terms with short, their abstract name by their own sources."""
    return terms.withColumn("short", abstract_name(F.col("name"), F.col("sources")))


def abstract_terms(terms: DataFrame, mappings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(terms, mappings) under abstract names: terms that get one name are one, the old names are synonyms. Attributes that are mapped to a term count as its sources."""
    used = mappings.groupBy(F.lower("canonical").alias("key")).agg(F.collect_set("attribute").alias("used"))
    keyed = terms.withColumn("key", F.lower("name")).join(used, "key", "left")
    short = abstract_name(F.col("name"), F.concat("sources", F.coalesce("used", F.array().cast("array<string>"))))
    named = keyed.withColumn("short", short).withColumn("short", F.when(F.lower("short") == F.col("key"), F.col("name")).otherwise(F.col("short")))
    row = F.struct("pos", "short", "name", "description", "synonyms", "sources")
    grouped = named.groupBy(F.lower("short").alias("key")).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    name = F.get("rows", 0)["short"]
    synonyms = F.flatten(F.transform("rows", lambda r: F.concat(r["synonyms"], F.array(r["name"]))))
    out = grouped.select(name.alias("name"), _longest(F.col("rows")).alias("description"), _synonyms(synonyms, name).alias("synonyms"), F.array_distinct(F.flatten(F.transform("rows", lambda r: r["sources"]))).alias("sources"), F.get("rows", 0)["pos"].alias("pos"))
    renames = named.filter(F.lower("short") != F.col("key")).groupBy("key").agg(F.max_by("short", "pos").alias("short"))
    moved = mappings.withColumn("key", F.lower("canonical")).join(renames, "key", "left").withColumn("canonical", F.coalesce("short", "canonical"))
    return out, moved.select(*mappings.columns)


def votes(mappings: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(part, name, votes): for each bare attribute name the term that most mappings, and sources of terms if they are given, give it; ties by name."""
    each = mappings.select(bare_key(attribute_part("attribute")).alias("part"), F.col("canonical").alias("name"))
    if terms is not None:
        each = each.union(terms.select("name", F.explode("sources").alias("source")).select(bare_key(attribute_part("source")), "name"))
    counted = each.filter("part <> ''").groupBy("part", "name").agg(F.count(F.lit(1)).alias("votes"))
    return _first(counted, [F.col("part")], [-F.col("votes"), F.lower("name"), F.col("name")])


def covered(mappings: DataFrame, attributes: DataFrame, terms: DataFrame) -> DataFrame:
    """(attribute, canonical, confidence, source, epos, apos): mappings for the attributes that have none, in the model's order.

    An attribute takes the term that most attributes of its name have, else a term with its abstract or plain name as name
    or synonym, else its abstract name as a new term. What is decided counts for the attributes after it: the first one of
    each name decides for all of them, and a new term is found by later ones. The first ones are decided in rounds (see
    ``_new_names``); nothing is gone through on the driver.
    """
    shown, at = F.concat_ws(".", "entity", "attr"), F.struct("epos", "apos").alias("at")
    title = once(tokens("attr"), lambda words: F.when(F.size(words) == 0, F.col("attr")).otherwise(term(words)))
    missing = attributes.select(shown.alias("attribute"), "attr", "epos", "apos").withColumn("key", qualified_key("attribute")).join(mappings.select(qualified_key("attribute").alias("key")).distinct(), "key", "left_anti")
    short = once(title, lambda t: F.coalesce(F.nullif(abstract_name(t, F.array("attribute")), F.lit("")), t))
    part = once(bare_key("attr"), lambda k: F.when(k == "", F.concat(F.lit(" "), "attribute")).otherwise(k))  # names without letters stand for themselves
    rows = checkpointed(missing.select("attribute", "epos", "apos", at, part.alias("part"), short.alias("short"), bare_key(short).alias("short_key"), bare_key(title).alias("title_key")))
    every = terms.select("pos", F.lit(-1).alias("place"), "name", F.col("name").alias("spelled")).union(terms.select("pos", F.posexplode("synonyms").alias("place", "spelled"), "name").select("pos", "place", "name", "spelled"))
    keyed = every.select("name", F.struct("pos", "place").alias("o"), (F.col("place") >= 0).alias("also"), bare_key("spelled").alias("key")).filter("key <> ''")
    index = keyed.groupBy("key").agg(F.min_by(F.struct("also", "name"), F.struct("also", "o")).alias("hit"))  # a name beats a synonym, then the first
    hit = lambda name: index.select(F.col("key").alias(f"{name}_key"), F.col("hit").alias(f"{name}_hit"))
    heads = rows.groupBy("part").agg(F.min_by(F.struct("at", "short", "short_key", "title_key"), "at").alias("h")).select("part", "h.*")
    heads = heads.join(votes(mappings, terms).select("part", F.col("name").alias("voted")), "part", "left").join(hit("short"), "short_key", "left").join(hit("title"), "title_key", "left")
    heads = checkpointed(heads)
    open_ = heads.filter("voted is null and short_hit is null")
    new = _new_names(open_.filter("title_hit is null").select("at", "short", "short_key", "title_key"))
    found = lambda key: new.select(F.col("key").alias(f"{key}_key"), F.col("name").alias(f"{key}_new"), F.col("at").alias(f"{key}_at"))
    both = heads.join(found("short"), "short_key", "left").join(found("title"), "title_key", "left")
    before = lambda key: F.when(F.col("voted").isNull() & F.col("short_hit").isNull() & (F.col(f"{key}_at") < F.col("at")), F.col(f"{key}_new"))
    kind = lambda x: F.when(x["also"], "synonym").when(x["name"].isNotNull(), "name")
    by_title = F.when(F.col("title_hit").isNull(), before("title"))
    how = F.when(F.col("voted").isNotNull(), "votes").otherwise(F.coalesce(kind(F.col("short_hit")), F.when(before("short").isNotNull(), "name"), kind(F.col("title_hit")), F.when(by_title.isNotNull(), "name"), F.lit("new")))
    name = F.coalesce("voted", F.col("short_hit.name"), before("short"), F.col("title_hit.name"), by_title, F.col("short"))
    decided = both.select("part", F.col("at").alias("first"), name.alias("canonical"), how.alias("how"))
    out = rows.join(decided, "part").withColumn("source", F.when(F.col("at") == F.col("first"), F.col("how")).otherwise("votes"))
    sure = F.create_map(*[F.lit(x) for pair in zip(("votes", "name", "synonym", "new"), FILLED, strict=True) for x in pair])
    return out.select("attribute", "canonical", sure[F.col("source")].alias("confidence"), "source", "epos", "apos")


def _new_names(open_: DataFrame) -> DataFrame:
    """(key, name, at): the new terms that rows (at, short, short_key, title_key) make, gone through by ``at``: a row makes one unless an earlier row made one with its short or title key.

    In each round those rows are decided that no undecided earlier row can touch; the number of rounds is the length of the
    longest chain of rows whose title key is another's short key.
    """
    open_ = checkpointed(open_)
    new = checkpointed(open_.limit(0).select(F.col("short_key").alias("key"), F.col("short").alias("name"), "at"))
    while not open_.isEmpty():
        first = open_.groupBy("short_key").agg(F.min("at").alias("first"))
        both = open_.join(first, "short_key").join(first.select(F.col("short_key").alias("title_key"), F.col("first").alias("other")), "title_key", "left")
        ready = both.filter((F.col("at") == F.col("first")) & (F.col("other").isNull() | (F.col("other") >= F.col("at"))))
        made = new.select(F.col("key").alias("title_key"), F.col("at").alias("made"))
        more = ready.join(made, "title_key", "left").filter(F.col("made").isNull() | (F.col("made") > F.col("at")))
        new = checkpointed(new.unionByName(more.select(F.col("short_key").alias("key"), F.col("short").alias("name"), "at")))
        done = ready.select("at").union(open_.join(new.select(F.col("key").alias("short_key"), F.col("at").alias("made")), "short_key").filter("made < at").select("at"))
        open_ = checkpointed(open_.join(done.distinct(), "at", "left_anti"))
    return new


def covered_entities(mappings: DataFrame, entities: DataFrame, approved: DataFrame | None = None) -> DataFrame:
    """(source_entity, canonical, confidence, source, epos): mappings for entities that have none, in the model's order.

    An entity takes the canonical name that its source name has in the approved vocabulary's mappings, else one with the
    same bare name, else the one with the most words in common, else a new one. What is decided counts for those after it.
    """
    known = approved.select("source_entity", "canonical", F.lit(0).alias("side")) if approved is not None else mappings.select("source_entity", "canonical", F.lit(0).alias("side")).limit(0)
    known = known.union(mappings.select("source_entity", "canonical", F.lit(1)))
    names = known.select("side", bare_key("source_entity").alias("key"), entity_label("canonical").alias("name")).filter("name <> ''").withColumns({"name_key": bare_key("name"), "words": tokens("name")}).orderBy("side", "key", "name").collect()
    label = entity_label("entity")
    rows = entities.select("entity", "epos", bare_key("entity").alias("key"), label.alias("label"), bare_key(label).alias("label_key"), tokens("entity").alias("words"), tokens(label).alias("label_words")).orderBy("epos").collect()
    mapped = {r["key"] for r in mappings.select(bare_key("source_entity").alias("key")).distinct().collect()}
    by_source: dict[str, str] = {}
    for r in names:
        if r["key"]:
            by_source.setdefault(r["key"], r["name"])
    pool = {r["name"]: (r["name_key"], set(r["words"])) for r in names}
    done = []
    for r in rows:
        if r["key"] in mapped:
            continue
        ordered = sorted(pool, key=lambda n: (n.lower(), n))
        same = [n for n in ordered if pool[n][0] == r["label_key"]]
        mine = set(r["words"])
        shared = {n: len(mine & pool[n][1]) / len(mine | pool[n][1]) for n in ordered if mine and pool[n][1]}
        near = max(ordered, key=lambda n: shared.get(n, 0.0), default=None)
        if r["key"] and r["key"] in by_source:
            how, name = 0, by_source[r["key"]]
        elif same:
            how, name = 1, same[0]
        elif near is not None and shared.get(near, 0.0) >= TOKENS:
            how, name = 2, near
        else:
            how, name = 3, r["label"]
        done.append((r["entity"], name, FILLED_ENTITY[how], ("approved", "name", "words", "new")[how], r["epos"]))
        mapped.add(r["key"])
        by_source[r["key"]] = name
        pool.setdefault(name, (r["label_key"], set(r["label_words"])))
    return entities.sparkSession.createDataFrame(done, "source_entity string, canonical string, confidence double, source string, epos int")


def finalized_entities(mappings: DataFrame, entities: DataFrame, approved: DataFrame | None = None) -> DataFrame:
    """(source_entity, canonical, confidence, rationale, seq): one mapping for each entity of the model, from the approved ones, the new ones and coverage."""
    names = ["source_entity", "canonical", "confidence", "rationale", "seq"]
    both = carried_forward(approved.select(*names), mappings.select(*names)) if approved is not None else mappings.select(*names)
    own = valid_entity_mappings(deduplicated(both, "source_entity"), entities)
    last = own.agg(F.coalesce(F.max("seq") + 1, F.lit(0)).alias("last"))
    more = covered_entities(own, entities, approved).crossJoin(F.broadcast(last))
    return valid_entity_mappings(own.select(*names).unionByName(more.select("source_entity", "canonical", "confidence", F.col("source").alias("rationale"), (F.col("epos") + F.col("last")).alias("seq"))), entities)


def reified(mappings: DataFrame, hints: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """mappings with canonical names replaced by an attribute's preferred term where role and name call for it; hints: (entity, attr, role, preferred)."""
    return reify(mappings, hints, terms)[0]


def reify(mappings: DataFrame, hints: DataFrame, terms: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(mappings, terms): a mapping moves to its attribute's preferred term if that is called for, and its old name becomes a synonym there.

    A preferred term is known by the name of a term that has it as name or synonym, as the terms are by then. It is called
    for if both names are equal but for signs, if the attribute identifies, if the old name is the preferred one behind words
    of the entity, or if the attribute qualifies a relationship and the old name holds the preferred one.
    """
    spark = mappings.sparkSession
    if terms is None:
        terms = spark.createDataFrame([], "name string, description string, synonyms array<string>, sources array<string>, pos int")
    wanted = hints.filter("trim(preferred) <> ''").select(qualified_key(F.concat_ws(".", "entity", "attr")).alias("key"), F.trim("preferred").alias("want"), "role", "entity")
    hinted = mappings.withColumn("key", qualified_key("attribute")).join(wanted.groupBy("key").agg(F.first(F.struct("want", "role", "entity")).alias("hint")), "key")
    rows = hinted.select("seq", "canonical", "hint.*").orderBy("seq").collect()
    known = [[r["name"], r["description"], list(r["synonyms"] or []), list(r["sources"] or []), r["pos"]] for r in terms.orderBy("pos").collect()]
    spelled = {x for r in rows for x in (r["canonical"], r["want"], r["entity"])} | {x for t in known for x in (t[0], *t[2])}
    facts = spark.createDataFrame([(x,) for x in sorted(filter(None, spelled))], "x string").select("x", bare_key("x").alias("key"), tokens("x").alias("words"))
    of = {r["x"]: (r["key"], r["words"]) for r in facts.collect()}
    place: dict[str, str] = {}
    for t in known:
        place.setdefault(of[t[0]][0], t[0])
    for t in known:
        for x in t[2]:
            place.setdefault(of[x][0], t[0])
    moved = {}
    for r in rows:
        name = place.get(of[r["want"]][0], r["want"])
        (old, old_words), (key, words) = of[r["canonical"]], of[name]
        before = old_words[: len(old_words) - len(words)]
        prefixed = words and before and old_words[len(before) :] == words and set(before) <= set(of[r["entity"]][1])
        identifies = r["role"] in ("identifier", "foreign_identifier")
        if not old or not key or not (old == key or identifies or prefixed or r["role"].startswith("relationship_") and key in old):
            continue
        if r["canonical"].lower() != name.lower():
            moved[r["seq"]] = name
            held = next((t for t in known if t[0].lower() == name.lower()), None)
            if held is None:
                known.append(held := [name, None, [], [], 1 + max((t[4] for t in known), default=-1)])
                place.setdefault(key, name)
            if r["canonical"].lower() not in {x.lower() for x in held[2]}:
                held[2].append(r["canonical"])
                place.setdefault(old, held[0])
    changes = spark.createDataFrame(list(moved.items()), "seq long, moved string")
    out = mappings.join(F.broadcast(changes), "seq", "left").withColumn("canonical", F.coalesce("moved", "canonical"))
    return out.select(*mappings.columns), spark.createDataFrame([tuple(t) for t in known], terms.select("name", "description", "synonyms", "sources", "pos").schema)


def annotated(terms: DataFrame, hints: DataFrame, relators: DataFrame) -> DataFrame:
    """terms with roles and contexts: what their sources do in their entities, and which of these are among the relators (entity)."""
    facts = hints.select(qualified_key(F.concat_ws(".", "entity", "attr")).alias("key"), "role", "entity").join(relators.select("entity").distinct().withColumn("relator", F.lit(True)), "entity", "left")
    each = terms.select("pos", F.explode("sources").alias("source")).withColumn("key", qualified_key("source")).join(facts, "key")
    found = each.groupBy("pos").agg(F.sort_array(F.collect_set("role")).alias("roles"), F.sort_array(F.collect_set(F.when(F.col("relator"), F.col("entity")))).alias("contexts"))
    empty = F.array().cast("array<string>")
    return terms.join(found, "pos", "left").select(*terms.columns, F.coalesce("roles", empty).alias("roles"), F.coalesce("contexts", empty).alias("contexts"))


def aligned(terms: DataFrame, mappings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(terms, mappings): every mapping names a term as it is spelled, and its attribute is among the term's sources.

    A canonical name is that of a term, else a synonym (of the last term that has it), else a new term.
    """
    spelled = terms.select("name", "pos", F.posexplode("synonyms").alias("place", "key")).groupBy(F.lower("key").alias("low")).agg(F.max_by(F.lower("name"), F.struct("pos", "place")).alias("synonym"))
    own = terms.select(F.lower("name").alias("low")).distinct().withColumn("own", F.col("low"))
    keyed = mappings.withColumn("low", F.lower("canonical")).join(own, "low", "left").join(spelled, "low", "left").withColumn("key", F.coalesce("own", "synonym", "low"))
    used = keyed.groupBy("key").agg(F.min_by("canonical", "seq").alias("fresh"), F.min("seq").alias("first"), F.transform(F.sort_array(F.collect_list(F.struct("seq", "attribute"))), lambda x: x["attribute"]).alias("used"))
    both = terms.withColumn("key", F.lower("name")).join(used, "key", "full")
    last = terms.agg(F.coalesce(F.max("pos") + 1, F.lit(0)).alias("last"))
    place = F.row_number().over(Window.orderBy(F.col("pos").isNotNull(), "first")) - 1  # a row for each term
    empty = F.array().cast("array<string>")
    both = both.withColumn("new", F.when(F.col("pos").isNull(), place)).crossJoin(F.broadcast(last)).withColumn("name", F.coalesce("name", "fresh"))
    sources = F.array_distinct(F.concat(F.coalesce("sources", empty), F.filter(F.coalesce("used", empty), lambda x: x != "")))
    grown = both.select("key", "name", F.coalesce("description", F.lit("")).alias("description") if "description" not in terms.columns else F.col("description"), _synonyms(F.coalesce("synonyms", empty), F.col("name")).alias("synonyms"), sources.alias("sources"), F.coalesce("pos", F.col("new") + F.col("last")).cast("int").alias("pos"))
    renamed = keyed.join(grown.select("key", F.col("name").alias("spelling")), "key").withColumn("canonical", F.col("spelling"))
    return grown.drop("key"), renamed.select(*mappings.columns)


def aligned_terms(terms: DataFrame, mappings: DataFrame) -> DataFrame:
    """The terms of ``aligned``: with a new one for each canonical name that no term has."""
    return aligned(terms, mappings)[0]


def owned_sources(terms: DataFrame, mappings: DataFrame) -> DataFrame:
    """terms without sources that are mapped to another term, and with all that are mapped to them; a source that no mapping mentions stays."""
    last = mappings.groupBy(qualified_key("attribute").alias("key")).agg(F.max_by(F.lower("canonical"), "seq").alias("owner"), F.max_by("attribute", "seq").alias("shown"), F.min("seq").alias("first")).filter("key <> ''")
    held = terms.select("pos", F.lower("name").alias("low"), F.posexplode("sources").alias("place", "source")).withColumn("key", qualified_key("source")).filter("key <> ''").join(last.select("key", "owner"), "key", "left").filter("owner is null or owner = low")
    kept = held.groupBy("pos").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "source"))), lambda x: x["source"]).alias("kept"))
    mine = last.groupBy("owner").agg(F.transform(F.sort_array(F.collect_list(F.struct("first", "shown"))), lambda x: x["shown"]).alias("mine"))
    both = terms.withColumn("owner", F.lower("name")).join(kept, "pos", "left").join(mine, "owner", "left")
    empty = F.array().cast("array<string>")
    return both.withColumn("sources", distinct_by(F.concat(F.coalesce("kept", empty), F.coalesce("mine", empty)), qualified_key)).select(*terms.columns)


def plain_vocabulary(attributes: DataFrame) -> DataFrame:
    """(name, synonyms, sources, confidence, pos): one term for each attribute name in lower case with underscores for spaces; its synonyms are the spellings."""
    name = F.regexp_replace(F.lower(F.trim("attr")), " ", "_")
    row = F.sort_array(F.collect_list(F.struct("epos", "apos", "attr", F.concat_ws(".", "entity", "attr").alias("source"))))
    grouped = attributes.groupBy(name.alias("name")).agg(row.alias("rows"))
    pos = F.row_number().over(Window.orderBy(F.get("rows", 0))) - 1  # a row for each term
    return grouped.select("name", F.transform("rows", lambda r: r["attr"]).alias("synonyms"), F.transform("rows", lambda r: r["source"]).alias("sources"), F.lit(0.5).alias("confidence"), pos.alias("pos"))


def instance_score(best_overlap: Column, same_kind: Column, members: Column, kind: Column, term_words: Column) -> Column:
    """0.7 of the best value overlap and 0.3 of the share of members of the same kind; without members, what kind and name suggest."""
    guess = F.when((kind == "date") & has_any(term_words, TEMPORAL), 0.8).when((kind == "numeric") & has_any(term_words, MEASURE), 0.8).when((kind == "text") & ~has_any(term_words, TEMPORAL), 0.5).otherwise(0.0)
    return F.when(members > 0, 0.7 * best_overlap + 0.3 * same_kind).otherwise(guess)


def attribute_scores(attributes: DataFrame, terms: DataFrame, evidence: DataFrame, kinds: DataFrame) -> DataFrame:
    """(entity, attr, name, syntactic, instance, structural, score) of each attribute with each term; both are metadata.

    evidence: (a, b, overlap), value overlaps of bare attribute names; kinds: (part, kind) of their values.
    """
    c = F.col
    pairs = attributes.select("entity", "attr", "epos", "apos", bare_key("attr").alias("a")).crossJoin(F.broadcast(terms.select("name", "synonyms", "sources", "pos")))
    syn = F.greatest(hybrid(c("attr"), c("name")), F.coalesce(F.array_max(F.transform("synonyms", lambda s: hybrid(c("attr"), s))), F.lit(0.0)))
    struct = F.coalesce(F.array_max(F.transform("sources", lambda s: F.coalesce(hybrid(c("entity"), entity_part(s)), F.lit(0.0)))), F.lit(0.0))
    known = kinds.select(c("part").alias("a"), c("kind").alias("kind"))
    pairs = pairs.join(F.broadcast(known), "a", "left").withColumns({"syntactic": syn, "structural": struct, "kind": F.coalesce("kind", F.lit("unknown"))})
    member = pairs.select("entity", "attr", "name", "a", "kind", F.explode(F.array_distinct("sources")).alias("s")).withColumn("b", bare_key(attribute_part("s")))
    member = member.join(F.broadcast(evidence), ["a", "b"], "left").join(F.broadcast(kinds.select(c("part").alias("b"), c("kind").alias("other"))), "b", "left")
    seen = member.groupBy("entity", "attr", "name").agg(F.max(F.coalesce("overlap", F.lit(0.0))).alias("best"), F.avg(F.when((c("kind") == c("other")) & (c("kind") != "unknown"), 1.0).otherwise(0.0)).alias("same"))
    both = pairs.join(seen, ["entity", "attr", "name"], "left").withColumn("instance", instance_score(F.coalesce("best", F.lit(0.0)), F.coalesce("same", F.lit(0.0)), F.size("sources"), c("kind"), tokens("name")))
    return both.select("entity", "attr", "epos", "apos", "name", "pos", "syntactic", "instance", "structural", (0.4 * c("syntactic") + 0.4 * c("instance") + 0.2 * c("structural")).alias("score"))


def entity_scores(entities: DataFrame, canon: DataFrame, linked: DataFrame) -> DataFrame:
    """(entity, canonical, score): name, shared attributes and whether the entity has any relationship. entities and canon: (entity|canonical, attrs array of bare names); linked: (entity)."""
    c = F.col
    pairs = entities.select("entity", c("attrs").alias("mine")).crossJoin(F.broadcast(canon.select("canonical", c("attrs").alias("theirs"))))
    pairs = pairs.join(F.broadcast(linked.distinct().withColumn("_l", F.lit(True))), "entity", "left")
    return pairs.select("entity", "canonical", (0.5 * hybrid(c("entity"), c("canonical")) + 0.3 * jaccard(c("mine"), c("theirs")) + 0.2 * F.when(c("_l"), 1.0).otherwise(0.5)).alias("score"))


def build_entities(entities: DataFrame, canon: DataFrame, linked: DataFrame) -> DataFrame:
    """(source_entity, canonical, confidence, is_new, epos): each entity (entity, epos, attrs) reuses the best canonical entity or gets its own name; of entities with one bare name the first counts."""
    once = entities.groupBy(bare_key("entity").alias("key")).agg(F.min_by(F.struct("entity", "attrs", "epos"), "epos").alias("row")).filter("key <> ''").select("row.*")
    best = entity_scores(once, canon, linked).groupBy("entity").agg(F.min_by(F.struct("canonical", "score"), F.struct(-F.col("score"), "canonical")).alias("best"))
    both = once.join(best, "entity", "left").withColumn("reuse", F.coalesce(F.col("best.score") >= ENTITY, F.lit(False)))
    return both.select(F.col("entity").alias("source_entity"), F.when(F.col("reuse"), F.col("best.canonical")).otherwise(entity_label("entity")).alias("canonical"), F.when(F.col("reuse"), F.col("best.score")).otherwise(NEW_ENTITY).alias("confidence"), (~F.col("reuse")).alias("is_new"), "epos")


def build_terms(attributes: DataFrame, terms: DataFrame, evidence: DataFrame, kinds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mappings, terms): each attribute reuses the best term or makes one, in the model's order.

    Each attribute changes the terms that later ones are compared with. All similarities that may be asked for are
    computed by Spark at once: of attributes with all names, of entities with all entities. The decisions then only look
    them up. mappings: (attribute, canonical, confidence, is_new, seq); confidence is the score or NEW_TERM.
    """
    spark = attributes.sparkSession
    fresh = F.when(F.size(tokens("attr")) == 0, F.col("attr")).otherwise(term(tokens("attr")))
    rows = attributes.select("entity", "attr", bare_key("attr").alias("part"), fresh.alias("fresh"), "epos", "apos").orderBy("epos", "apos").collect()
    flag = lambda values: has_any(tokens("name"), values)
    known = terms.withColumns({"temporal": flag(TEMPORAL), "measure": flag(MEASURE), "owners": F.transform("sources", lambda s: F.struct(s.alias("source"), entity_part(s).alias("entity"), bare_key(attribute_part(s)).alias("part")))}).orderBy("pos").collect()
    held = {r["name"].lower(): {"name": r["name"], "description": r["description"] if "description" in r else None, "synonyms": list(r["synonyms"] or []), "owners": {o["source"]: (o["entity"], o["part"]) for o in r["owners"]}, "flags": (r["temporal"], r["measure"])} for r in known}
    names = {x for t in held.values() for x in (t["name"], *t["synonyms"])} | {r["fresh"] for r in rows} | {r["attr"] for r in rows}
    owners = {e for t in held.values() for e, _ in t["owners"].values() if e} | {r["entity"] for r in rows}
    frame = lambda xs, c: spark.createDataFrame([(x,) for x in sorted(xs)], f"{c} string")
    pairs = lambda xs, ys: {(r[0], r[1]): r[2] for r in frame(xs, "x").crossJoin(F.broadcast(frame(ys, "y"))).select("x", "y", hybrid(F.col("x"), F.col("y")).alias("s")).filter("s > 0").collect()}
    near, near_entity = pairs({r["attr"] for r in rows}, names), pairs({r["entity"] for r in rows}, owners)
    overlap, kind = {(r["a"], r["b"]): r["overlap"] for r in evidence.collect()}, {r["part"]: r["kind"] for r in kinds.collect()}

    def score(r, t: dict) -> float:
        syntactic = max(near.get((r["attr"], x), 0.0) for x in (t["name"], *t["synonyms"]))
        structural = max((near_entity.get((r["entity"], e), 0.0) for e, _ in t["owners"].values()), default=0.0)
        mine = kind.get(r["part"], "unknown")
        if t["owners"]:
            parts = [p for _, p in t["owners"].values()]
            same = sum(mine != "unknown" and kind.get(p) == mine for p in parts) / len(parts)
            instance = 0.7 * max(overlap.get((r["part"], p), 0.0) for p in parts) + 0.3 * same
        else:
            temporal, measure = t["flags"]
            instance = 0.8 if mine == "date" and temporal or mine == "numeric" and measure else 0.5 if mine == "text" and not temporal else 0.0
        return 0.4 * syntactic + 0.4 * instance + 0.2 * structural

    done = []
    for seq, r in enumerate(rows):
        source = f"{r['entity']}.{r['attr']}"
        scored = [(score(r, t), -i, t) for i, t in enumerate(held.values())]
        best = max(scored, key=lambda x: x[:2], default=None)
        if best is not None and best[0] >= TERM:
            sure, target = float(best[0]), best[2]
        else:
            sure = None
            target = held.setdefault(r["fresh"].lower(), {"name": r["fresh"], "description": f"Made from {source}.", "synonyms": [], "owners": {}, "flags": (False, False)})
            if r["attr"] not in target["synonyms"]:
                target["synonyms"].append(r["attr"])
        target["owners"].setdefault(source, (r["entity"], r["part"]))
        done.append((source, target["name"], NEW_TERM if sure is None else sure, sure is None, seq))
    grown = [(t["name"], t["description"], t["synonyms"], list(t["owners"]), i) for i, t in enumerate(held.values())]
    return spark.createDataFrame(done, "attribute string, canonical string, confidence double, is_new boolean, seq int"), spark.createDataFrame(grown, "name string, description string, synonyms array<string>, sources array<string>, pos int")


def build(attributes: DataFrame, terms: DataFrame, evidence: DataFrame, kinds: DataFrame) -> DataFrame:
    """The mappings of ``build_terms``."""
    return build_terms(attributes, terms, evidence, kinds)[0]


def enriched(attributes: DataFrame, samples: DataFrame, index: DataFrame, hints: DataFrame) -> DataFrame:
    """(entity, attr, logical_type, normalization, semantic_role, domain, unit, currency, confidence) of each attribute.

    samples: (part, samples array) and index: (col, pos, value, cnt) of a value index, both by bare attribute name; hints:
    (entity, attr, role).
    """
    c, empty = F.col, F.array().cast("array<string>")
    shares = kind_shares(index).select(bare_key("col").alias("part"), "numbers", "truths", "dates")
    cats = categories(index).select(bare_key("col").alias("part"), "is_category", c("domain").alias("found"))
    rows = attributes.withColumns({"part": bare_key("attr"), "words": tokens("attr")}).join(F.broadcast(hints.select("entity", "attr", "role")), ["entity", "attr"], "left")
    for other in (shares, cats, samples):
        rows = rows.join(F.broadcast(other), "part", "left")  # a row for each column name
    rows = rows.na.fill(0.0, ["numbers", "truths", "dates"]).withColumn("samples", F.coalesce("samples", empty))
    logical = V.logical_type(c("words"), c("data_type"), c("role"), c("is_pk"), c("is_fk"), c("truths"), c("dates"), c("numbers"), F.coalesce("is_category", F.lit(False)))
    rows = rows.withColumn("logical_type", logical)
    domain = F.when(c("logical_type") == "boolean", F.array(F.lit("false"), F.lit("true"))).when(c("logical_type").isin("categorical", "text"), c("found"))
    rows = rows.withColumn("domain", F.coalesce(domain, empty))
    sure = V.confidence(c("logical_type"), c("data_type"), F.size("samples") > 0, c("role"), c("domain"), F.greatest("numbers", "truths", "dates"))
    return rows.select("entity", "attr", "logical_type", V.normalization(c("logical_type"), c("words"), c("domain")).alias("normalization"), V.semantic_role(c("words"), c("logical_type")).alias("semantic_role"), "domain", V.unit(c("words"), c("samples")).alias("unit"), V.currency(c("words"), c("samples")).alias("currency"), sure.alias("confidence"))
