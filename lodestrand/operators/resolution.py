"""Entity resolution of the property graph: by shared identifiers, by name and jurisdiction, and pairs to review.

Entities are (entity_id, kind, name, metadata map, confidence, evidence_count),
one row for each id; a status of rejected or superseded, where there is such a
column, leaves them out. A group of equal entities may be of any size: it is
reduced to one row before its members are joined to it, and that row is copied
over salts, so that no group needs one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normal_name
from ..sources.tables import staged
from .graph import fuzzy_pairs

#: Tasks that the members of one group may be dealt over.
SALTS = 16
#: Keys of metadata that identify an entity, and the name each goes by.
IDENTIFIER_KEYS = {"cik": "cik", "lei": "lei", "ticker": "ticker", "domain": "domain", "website": "domain", "duns": "duns", "ein": "ein", "taxId": "tax_id", "tax_id": "tax_id", "registryId": "registry_id", "registry_id": "registry_id"}
#: Words that make names material to tell apart.
QUALIFIERS = "bank capital energy financial finance global group health hospitality insurance medical online partners properties realty reit research systems technologies trust".split()


def identifiers(metadata: Column) -> Column:
    """The sorted distinct `key:value` identifiers in a map of strings: no scheme, www or spaces; a domain without its path, a cik without leading zeros."""
    found = []
    for key, name in IDENTIFIER_KEYS.items():
        value = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.try_element_at(metadata, F.lit(key))), "^https?://", ""), "^www\\.", ""), "\\s+", "")
        if name == "domain":
            value = F.regexp_replace(value, "(?s)[/?#].*$", "")
        if name == "cik":
            value = F.regexp_replace(value, "^0+(?=[0-9])", "")
        found.append(F.when(value != "", F.concat(F.lit(f"{name}:"), value)))
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*found))))


def active(entities: DataFrame) -> DataFrame:
    return entities.where(~F.coalesce(F.col("status").isin("rejected", "superseded"), F.lit(False))) if "status" in entities.columns else entities


def registered_targets(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(entity_id, targets): the sorted distinct names of what each entity is registered in; jurisdictions are few for each."""
    places = active(entities).select(F.col("entity_id").alias("target"), normal_name(F.col("name")).alias("_place")).where("_place <> ''")
    links = edges.where("kind = 'registered_in'").select("source", "target").join(places, "target")
    return links.groupBy(F.col("source").alias("entity_id")).agg(F.array_sort(F.collect_set("_place")).alias("targets"))


def _spread(members: DataFrame, groups: DataFrame, on: list[str]) -> DataFrame:
    """Members with their group's row, dealt over salts. The copies are never broadcast: Spark takes their size for that of the groups."""
    salted = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return members.withColumn("_salt", F.pmod(F.xxhash64("entity_id"), F.lit(SALTS)).cast("int")).join(salted.hint("merge"), [*on, "_salt"]).drop("_salt")


def _merged(members: DataFrame, on: list[str]) -> DataFrame:
    """(entity_id, canonical_id) of groups of two or more: the best is the most confident, with most evidence, then the first id."""
    best = F.min(F.struct((-F.col("confidence")).alias("c"), (-F.col("evidence_count")).alias("n"), "entity_id"))
    groups = members.groupBy(*on).agg(best.alias("b"), F.count("*").alias("_size")).where("_size > 1").select(*on, F.col("b.entity_id").alias("canonical_id"))
    return _spread(members.select("entity_id", *on), groups, on).select("entity_id", "canonical_id")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the nodes of edges (a, b): the least node that each is linked to, however far.

    Large star and small star in turn: every node's greater neighbours, then its
    smaller ones, are linked to its least neighbour, until nothing moves. Each
    round is a written table, and a hub's neighbours are dealt over salts.
    """
    both = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    own = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = None
    while True:
        around = both(own)
        least = around.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = _spread(around.withColumnRenamed("b", "entity_id"), least, ["a"]).where("entity_id > a").select(F.col("entity_id").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        met = _spread(large.withColumnRenamed("b", "entity_id"), least, ["a"])
        small = met.select(F.col("entity_id").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        own = staged(small, "links")
        now = tuple(own.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    roots = own.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def by_identifier(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(entity_id, canonical_id) of entities of one kind that share identifiers.

    The members of an identifier are a group, unless they are registered in
    different places. Groups that share an entity are one, however long the chain;
    so no entity that shares an identifier with another stays alone unless a
    conflict says so. Where such a chain links entities registered in different
    places, it is not merged whole: each of its entities goes with its first
    identifier instead.
    """
    at = registered_targets(entities, edges).select("entity_id", F.array_join("targets", "|").alias("_at"))
    own = active(entities).select("entity_id", "kind", "confidence", "evidence_count", F.explode(identifiers(F.col("metadata"))).alias("identifier")).join(at, "entity_id", "left")
    shared = own.groupBy("kind", "identifier").agg(F.count("*").alias("_n"), F.min("_at").alias("_low"), F.max("_at").alias("_high"), F.min("entity_id").alias("_least")).where("_n > 1 and (_low is null or _low = _high)")
    chosen = staged(_spread(own, shared.select("kind", "identifier", "_least"), ["kind", "identifier"]), "shared-identifiers")
    # A star for each group: as many links as members.
    linked = components(chosen.select(F.col("entity_id").alias("a"), F.col("_least").alias("b")))
    first = chosen.groupBy("entity_id", "kind", "confidence", "evidence_count").agg(F.min("identifier").alias("identifier"), F.first("_at").alias("_at")).join(linked.withColumnRenamed("node", "entity_id"), "entity_id")
    places = first.groupBy("root").agg(F.min("_at").alias("_low"), F.max("_at").alias("_high"))
    split = F.coalesce(F.col("_low") != F.col("_high"), F.lit(False))
    grouped = _spread(first, places, ["root"]).withColumn("_group", F.concat_ws("\n", "root", F.when(split, F.col("identifier"))))
    return _merged(grouped, ["_group"])


def by_name(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(entity_id, canonical_id) of entities of one kind, normalised name and set of places they are registered in."""
    at = registered_targets(entities, edges).select("entity_id", F.array_join("targets", ",").alias("_at"))
    named = active(entities).select("entity_id", "kind", "confidence", "evidence_count", normal_name(F.col("name")).alias("_name")).where("_name <> ''")
    return _merged(named.join(at, "entity_id", "left").fillna("", ["_at"]), ["kind", "_name", "_at"])


def rewired(edges: DataFrame, merges: DataFrame) -> DataFrame:
    """Edges between canonical entities; `moved` says that an end has changed."""
    own = merges.select("entity_id", "canonical_id")
    a = edges.join(own.toDF("source", "_s"), "source", "left").join(own.toDF("target", "_t"), "target", "left")
    source, target = F.coalesce("_s", "source"), F.coalesce("_t", "target")
    moved = (source != F.col("source")) | (target != F.col("target"))
    return a.withColumn("moved", moved).withColumn("source", source).withColumn("target", target).drop("_s", "_t")


def resolved(entities: DataFrame, edges: DataFrame, first: DataFrame | None = None) -> DataFrame:
    """(entity_id, canonical_id, merged_by) of all active entities: by identifier, then by name those that are left.

    `first` may be a written table of by_identifier; its plan is used four times.
    """
    first = by_identifier(entities, edges) if first is None else first
    left = active(entities).join(first.where("entity_id <> canonical_id").select("entity_id"), "entity_id", "left_anti")
    second = by_name(left, rewired(edges, first).drop("moved"))
    both = active(entities).select("entity_id").join(first.withColumnRenamed("canonical_id", "_one"), "entity_id", "left").withColumn("_own", F.coalesce("_one", "entity_id"))
    out = both.join(second.toDF("_own", "_two"), "_own", "left")
    why = F.when(F.col("_one").isNotNull(), "identifier").when(F.col("_two").isNotNull(), "name").otherwise("none")
    return out.select("entity_id", F.coalesce("_two", "_own").alias("canonical_id"), why.alias("merged_by"))


def review_classes(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(entity_id, class_id, name_id): entities of one kind, name and set of places are a class; class and name go by their smallest id."""
    named = active(entities).select("entity_id", "kind", normal_name(F.col("name")).alias("name")).where("name <> ''")
    own = named.join(registered_targets(entities, edges), "entity_id", "left").withColumn("_at", F.coalesce(F.array_join("targets", "|"), F.lit("")))
    classes = own.groupBy("kind", "name", "_at").agg(F.min("entity_id").alias("class_id"))
    names = own.groupBy("kind", "name").agg(F.min("entity_id").alias("name_id"))
    met = _spread(own.select("entity_id", "kind", "name", "_at"), classes, ["kind", "name", "_at"])
    return _spread(met, names, ["kind", "name"]).select("entity_id", "class_id", "name_id")


def review_pairs(entities: DataFrame, edges: DataFrame, least: float = 0.55, alike: float = 0.82) -> DataFrame:
    """(kind, left_id, right_id, score, material, conflict): much alike but different entities that a person should look at.

    A pair of names is given once, between the smallest ids of the two, and of one
    name each further class (other places) once, against the name's first; who
    belongs to a class says `review_classes`. So copies make no more pairs than
    there are classes. A pair needs a score of `least`, and `alike` or a material
    word that one name lacks or a conflict: a class of the left one has a place
    that a class of the right one, registered elsewhere, lacks.
    """
    named = active(entities).select("entity_id", "kind", normal_name(F.col("name")).alias("name")).where("name <> ''")
    classes = named.join(registered_targets(entities, edges), "entity_id", "left").groupBy("kind", "name", "targets").agg(F.min("entity_id").alias("id"))
    # Of a name: its first class, all places, and the places that all classes have which have any. Sets of places are as many as a name has.
    n_sets = F.count("targets")
    by_place = classes.select("kind", "name", F.explode("targets").alias("p")).groupBy("kind", "name", "p").agg(F.count("*").alias("_c"))
    sets = classes.groupBy("kind", "name").agg(F.min(F.struct("id", "targets")).alias("first"), n_sets.alias("_sets"))
    places = by_place.join(sets.select("kind", "name", "_sets"), ["kind", "name"]).groupBy("kind", "name").agg(F.collect_set("p").alias("any"), F.collect_set(F.when(F.col("_c") == F.col("_sets"), F.col("p"))).alias("all"))
    names = sets.join(places, ["kind", "name"], "left")
    side = lambda s: names.select("kind", F.col("name").alias(f"{s}_name"), F.col("first.id").alias(f"{s}_class"), F.col("any").alias(f"{s}_any"), F.col("all").alias(f"{s}_all"))
    differ = fuzzy_pairs(active(entities), least).join(side("left"), ["kind", "left_name"]).join(side("right"), ["kind", "right_name"])
    turned = F.col("left_class") > F.col("right_class")
    x, y = F.when(turned, F.col("right_any")).otherwise(F.col("left_any")), F.when(turned, F.col("left_all")).otherwise(F.col("right_all"))
    left, right = F.split("left_name", " "), F.split("right_name", " ")
    extra = F.array_sort(F.filter(F.array_union(F.array_except(left, right), F.array_except(right, left)), lambda w: w.isin(QUALIFIERS)))
    clash = lambda a, b: F.coalesce(F.size(F.array_except(a, b)) > 0, F.lit(False)) & a.isNotNull() & b.isNotNull()
    far = differ.select("kind", F.least("left_class", "right_class").alias("left_id"), F.greatest("left_class", "right_class").alias("right_id"), "score", F.array_join(extra, ",").alias("material"), clash(x, y).alias("conflict"))
    firsts = names.where("_sets > 0").select("kind", "name", F.col("first.id").alias("left_id"), F.col("first.targets").alias("_mine"))
    again = _spread(classes.withColumnRenamed("id", "entity_id"), firsts, ["kind", "name"]).where("entity_id <> left_id")
    near = again.select("kind", "left_id", F.col("entity_id").alias("right_id"), F.lit(1.0).alias("score"), F.lit("").alias("material"), clash(F.col("_mine"), F.col("targets")).alias("conflict"))
    out = far.unionByName(near)
    return out.where((F.col("score") >= alike) | (F.col("material") != "") | F.col("conflict"))


def review_class_pairs(entities: DataFrame, edges: DataFrame, least: float = 0.55, alike: float = 0.82) -> DataFrame:
    """(kind, left_id, right_id, score, material, conflict): the pairs of review_pairs between all classes, each with its own conflict.

    Entities of one kind, name and set of places are one class, which its smallest
    id stands for; copies are not expanded, and `review_classes` says who belongs
    to one. A pair needs a score of `least`, and `alike` or a material word that
    one name lacks or a place of the left one that the right one, registered
    elsewhere, lacks.
    """
    named = active(entities).select("entity_id", "kind", normal_name(F.col("name")).alias("name")).where("name <> ''")
    classes = named.join(registered_targets(entities, edges), "entity_id", "left").groupBy("kind", "name", "targets").agg(F.min("entity_id").alias("id"))
    a, b = (classes.select("kind", F.col("name").alias(f"{s}_name"), F.col("targets").alias(f"{s}_targets"), F.col("id").alias(f"{s}_class")) for s in ("left", "right"))
    differ = fuzzy_pairs(active(entities), least).join(a, ["kind", "left_name"]).join(b, ["kind", "right_name"])
    same = a.join(b.withColumn("left_name", F.col("right_name")), ["kind", "left_name"]).where("left_class < right_class").withColumn("score", F.lit(1.0))
    rows = differ.unionByName(same)
    turned = F.col("left_class") > F.col("right_class")
    x, y = F.when(turned, F.col("right_targets")).otherwise(F.col("left_targets")), F.when(turned, F.col("left_targets")).otherwise(F.col("right_targets"))
    left, right = F.split("left_name", " "), F.split("right_name", " ")
    extra = F.array_sort(F.filter(F.array_union(F.array_except(left, right), F.array_except(right, left)), lambda w: w.isin(QUALIFIERS)))
    conflict = F.coalesce(F.size(F.array_except(x, y)) > 0, F.lit(False)) & x.isNotNull() & y.isNotNull()
    out = rows.select("kind", F.least("left_class", "right_class").alias("left_id"), F.greatest("left_class", "right_class").alias("right_id"), "score", F.array_join(extra, ",").alias("material"), conflict.alias("conflict"))
    return out.where((F.col("score") >= alike) | (F.col("material") != "") | F.col("conflict"))
