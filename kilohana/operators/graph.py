"""Graph operators over node and edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kilohana.functions import text as T


def pairs(names: Column) -> Column:
    """All pairs a<b of a short sorted array, as structs."""
    return F.flatten(F.transform(names, lambda x, i: F.transform(F.slice(names, i + 2, F.greatest(F.size(names) - i - 1, F.lit(0))), lambda y: F.struct(x.alias("a"), y.alias("b")))))


def co_mentions(rows: DataFrame) -> DataFrame:
    """(a, b, weight) from (names): sorted distinct names of each document."""
    return rows.select(F.explode(pairs(F.col("names"))).alias("p")).groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count("*").alias("weight"))


def contained_names(rows: DataFrame, names: list[str], text: str = "hawaiiantext", key: str = "sentenceid") -> DataFrame:
    hit = F.array_compact(F.array(*[F.when(F.lower(F.col(text)).contains(n.lower()), F.lit(n)) for n in names]))
    return rows.select(key, F.explode(hit).alias("name"))


# Fixed values of the extractors: given names, words of places near a name, words that are no names.
FIRST_NAMES = [
    "John", "James", "Robert", "Michael", "William", "David", "Richard", "Joseph",
    "Thomas", "Charles", "Christopher", "Daniel", "Matthew", "Donald", "Mark",
    "Paul", "Steven", "Andrew", "Joshua", "Kenneth", "Kevin", "Brian", "George",
    "Timothy", "Ronald", "Jason", "Jeffrey", "Ryan", "Jacob", "Gary", "Nicholas",
    "Kamehameha", "Lahainaluna", "Kalani", "Hale", "Kealoha", "Nāmānā", "Kauanui",
]
FEMALE_NAMES = [
    "Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Barbara", "Susan",
    "Jessica", "Sarah", "Karen", "Nancy", "Lisa", "Betty", "Helen", "Sandra",
    "Donna", "Carol", "Ruth", "Sharon", "Michelle", "Laura", "Kimberly",
    "Deborah", "Dorothy",
]
PLACE_WORDS = ["island", "province", "city", "town", "village", "school", "campus"]
COMMON = ["the", "and", "for", "of", "in", "on", "at", "to", "by", "is", "was", "were", "are"]
#: (relation, what stands between the two names): fixed values.
VERBS = [
    ("FOUNDED", r"\s+(?:founded|established|created|built|started|ho['ʻ]?okumu|ho['ʻ]?okumu\s+ia)\s+"),
    ("LIVES_IN", r"\s+(?:lives?|lived|resides?|resided)\s+in\s+"),
    ("LIVES_IN", r"\s+(?:noho|noho\s+ma)\s+"),
    ("VISITED", r"\s+(?:visited|travel(?:ed|led)\s+to|went\s+to|kipa\s+i|hele\s+i)\s+"),
    ("STUDIED_AT", r"\s+(?:studied|attended|went\s+to\s+school\s+at|went\s+to\s+college\s+at|a['ʻ]?o\s+ma|a['ʻ]?o\s+i)\s+"),
    ("WORKED_AT", r"\s+(?:worked\s+at|works\s+at|served\s+at|hana\s+ma)\s+"),
    ("LEADS", r"\s+(?:led|heads?|directs?)\s+"),
]
PHRASE = r"([A-Z]\p{L}+(?:\s+[A-Z]\p{L}+){0,4})"
DATE = r"(?<![A-Za-z0-9_])(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4})(?![A-Za-z0-9_])"
#: Words of a plain relation and its kind, in order: fixed values.
BASIC_KINDS = [("founded", "FOUNDED"), ("visited", "VISITED"), ("lived", "LIVES_IN"), ("studied", "STUDIED_AT"), ("attended", "ATTENDED")]
#: Pairs of one text at most: a limit of the operator itself.
MOST_PAIRS = 200


def _runs(run: str, near: int) -> str:
    """A run of capitalised words with ``near`` characters on each side, as groups: before (1 or 2), run (3), after (4)."""
    return rf"(?s)(?=[A-Z][a-z])(?<![A-Za-z0-9_])(?<=(?:\A(.{{0,{near - 1}}})|(.{{{near}}})))({run})(?![A-Za-z0-9_])(?=(.{{0,{near}}}))"


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it stands in ``use``: the variable of a lambda is never computed again."""
    return F.transform(F.array(value), use)[0]


def _named(kind: Column, name: Column) -> Column:
    return F.struct(name.alias("name"), kind.alias("kind"))


def _with_id(e: Column) -> Column:
    return F.struct(e["name"].alias("name"), e["kind"].alias("kind"), T.entity_id(e["kind"], e["name"]).alias("id"), T.entity_norm(e["name"]).alias("norm"))


def entity_array(text: Column) -> Column:
    """array<struct<name, kind, id, norm>>: the entities of a text in order, names first, then dates, each name and kind once.

    A run of capitalised words is a Person if it is a given name, a Location if a word of places stands in it or within 20 characters, else an Entity. One
    pass of one expression marks the runs with their surroundings, so nothing leaves the row.
    """
    marked = F.regexp_replace(text, _runs(r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*", 20), "\x01$1$2\x02$3\x02$4\x03")
    parts = F.split(marked, "\x01")
    runs = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: F.split(F.substring_index(x, "\x03", 1), "\x02"))

    near = "(?i)" + "|".join(PLACE_WORDS)

    def one(x):
        return _named(F.when(x[1].isin(FIRST_NAMES), "Person").when(F.concat(x[0], x[1], x[2]).rlike(near), "Location").otherwise("Entity"), x[1])

    names = F.transform(F.filter(runs, lambda x: ~F.lower(x[1]).isin(COMMON)), one)
    dates = F.transform(F.regexp_extract_all(text, F.lit(DATE), F.lit(0)), lambda x: _named(F.lit("Date"), x))
    return F.transform(F.array_distinct(F.concat(names, dates)), _with_id)


def basic_entity_array(text: Column) -> Column:
    """The plain extractor: single capitalised words, as Person by given name, else Location; dates and years apart. Ids are the type and the letters."""
    word = F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9_])[A-Z][a-z]+(?:[A-Z][a-z]+)*(?![A-Za-z0-9_])"), F.lit(0))

    def typed(kind, name):
        return F.struct(name.alias("name"), kind.alias("kind"), F.concat(kind, F.lit("_"), F.upper(F.regexp_replace(name, "[^a-zA-Z0-9]", "_"))).alias("id"))

    kind = lambda x: F.when(x.isin(FIRST_NAMES[:31] + FEMALE_NAMES), "Person").otherwise("Location")
    names = F.transform(F.filter(word, lambda x: ~F.lower(x).isin(COMMON[:-1])), lambda x: typed(kind(x), x))
    edge = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
    dates = F.transform(F.regexp_extract_all(text, F.lit(edge[0] + r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}" + edge[1]), F.lit(0)), lambda x: typed(F.lit("Date"), x))
    years = F.transform(F.regexp_extract_all(text, F.lit(edge[0] + r"\d{4}" + edge[1]), F.lit(0)), lambda x: typed(F.lit("Year"), x))
    return F.array_distinct(F.concat(names, dates, years))


def entities(rows: DataFrame, text: str, key: str) -> DataFrame:
    """(key, pos, name, kind, id): the entities of every text."""
    return rows.where(F.col(text).isNotNull()).select(key, F.posexplode(entity_array(F.col(text))).alias("pos", "e")).select(key, "pos", "e.name", "e.kind", "e.id")


def _resolved(ents: Column, name: Column) -> Column:
    """The id of the first entity that is the name, holds it or stands in it; null without one."""
    n = T.entity_norm(name)
    hit = F.filter(ents, lambda e: (n != "") & (e["norm"] != "") & (e["norm"].contains(n) | n.contains(e["norm"])))
    return F.try_element_at(hit, F.lit(1))["id"]


def relation_array(text: Column, ents: Column) -> Column:
    """array<struct<source, relation, target>>: relations that a verb between two names says, both names resolved among the text's entities."""
    return bound(F.struct(text.alias("text"), ents.alias("ents")), lambda s: _relations(s["text"], s["ents"]))


def _relations(text: Column, ents: Column) -> Column:

    def said(rx: str, rel: str):
        return lambda h: F.struct(_resolved(ents, F.regexp_extract(h, rx, 1)).alias("source"), F.lit(rel).alias("relation"), _resolved(ents, F.regexp_extract(h, rx, 2)).alias("target"))

    found = []
    for rel, verb in VERBS:
        rx = r"(?iu)(?:^|[^\p{L}\p{N}_])" + PHRASE + verb + PHRASE
        # Only texts with the verb are searched for names around it.
        hits = F.when(text.rlike("(?iu)" + verb), F.regexp_extract_all(text, F.lit(rx), F.lit(0))).otherwise(F.array().cast("array<string>"))
        found.append(F.transform(hits, said(rx, rel)))
    return F.array_distinct(F.filter(F.concat(*found), lambda r: r["source"].isNotNull() & r["target"].isNotNull() & (r["source"] != r["target"])))


def basic_relation_array(text: Column, ents: Column) -> Column:
    """The plain relations: a verb or 'is located in' between two names; a name is the last entity that holds it."""
    return bound(F.struct(text.alias("text"), ents.alias("ents")), lambda s: _basic_relations(s["text"], s["ents"]))


def _basic_relations(text: Column, ents: Column) -> Column:

    def held(name):
        hit = F.filter(ents, lambda e: F.lower(e["name"]).contains(F.lower(name)))
        return F.try_element_at(hit, F.lit(-1))["id"]

    def said(rx: str, kind):
        return lambda h: F.struct(held(F.regexp_extract(h, rx, 1)).alias("source"), kind(h).alias("relation"), held(F.regexp_extract(h, rx, 2)).alias("target"))

    def by_verb(h):
        e = F.lit("RELATED")
        for word, kind in reversed(BASIC_KINDS):
            e = F.when(F.lower(h).contains(word), kind).otherwise(e)
        return e

    out = []
    words = r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)"
    for rx, kind in (
        (r"(?i)" + words + r"\s+(?:founded|started|established|visited|created|built|lived|studied|attended)\s+([A-Z][a-z]+)", by_verb),
        (r"(?i)" + words + r"\s+(?:is|was)\s+(?:located|situated|found)\s+in\s+([A-Z][a-z]+)", lambda h: F.lit("LOCATED_IN")),
    ):
        hits = F.when(text.rlike(rx), F.regexp_extract_all(text, F.lit(rx), F.lit(0))).otherwise(F.array().cast("array<string>"))
        out.append(F.transform(hits, said(rx, kind)))
    return F.filter(F.concat(*out), lambda r: r["source"].isNotNull() & r["target"].isNotNull())


def co_occurrence_array(text: Column, ents: Column, most: int = MOST_PAIRS) -> Column:
    """array<struct<source, target>>: pairs of entities of one sentence, each once, the smaller id first, from the first ``most`` pairs of the text.

    Sentences end at . ! ? ; and line breaks. Once the pairs are full, no further sentence is looked at.
    """

    def two(ids):
        return F.flatten(F.transform(F.slice(ids, F.lit(1), F.lit(most)), lambda x, i: F.transform(F.slice(ids, i + 2, F.lit(most)), lambda y: F.struct(F.least(x, y).alias("source"), F.greatest(x, y).alias("target")))))

    def add(ents):
        def step(acc, low):
            ids = F.array_distinct(F.transform(F.filter(ents, lambda e: low.contains(e["low"])), lambda e: e["id"]))
            return F.when(F.size(acc) >= most, acc).otherwise(F.slice(F.concat(acc, bound(ids, two)), F.lit(1), F.lit(most)))

        return step

    none = F.array().cast("array<struct<source:string,target:string>>")
    small = F.transform(ents, lambda e: F.struct(F.lower(e["name"]).alias("low"), e["id"].alias("id")))
    both = F.struct(F.split(F.lower(text), r"[.!?;\n]+").alias("s"), small.alias("e"))
    return F.array_distinct(bound(both, lambda b: F.aggregate(b["s"], none, add(b["e"]))))


def extract(rows: DataFrame, text: str, key: str) -> DataFrame:
    """(key, ents): the entity array of every text, to take mentions and edges from."""
    return rows.where(F.col(text).isNotNull()).select(key, text, entity_array(F.col(text)).alias("ents"))


def degree(edges: DataFrame) -> DataFrame:
    """(id, degree) by either end."""
    return edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).groupBy("id").agg(F.count("*").alias("degree"))


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(degree(edges).select("id"), "id", "left_anti")


def merge_nodes(nodes: DataFrame) -> DataFrame:
    """One row per id: its least name and all its labels."""
    return nodes.groupBy("id").agg(F.min("name").alias("name"), F.array_sort(F.collect_set("label")).alias("labels"))


def merge_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, rel, dst, weight): repeated edges add up; both ends must exist."""
    ids = nodes.select("id").distinct()
    e = edges.groupBy("src", "rel", "dst").agg(F.count("*").alias("weight"))
    return e.join(ids, e["src"] == ids["id"], "left_semi").join(ids.withColumnRenamed("id", "id2"), F.col("dst") == F.col("id2"), "left_semi")


def two_hops(edges: DataFrame, start: str) -> DataFrame:
    """(path) of one and two steps from a node, undirected, no edge twice. Only the start's own edges are extended."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    one = both.where(F.col("src") == start).select(F.col("src").alias("a"), F.col("dst").alias("b"))
    two = one.join(both.select(F.col("src").alias("b"), F.col("dst").alias("c")), "b").where("c <> a")
    return one.select(F.concat_ws(">", "a", "b").alias("path")).unionByName(two.select(F.concat_ws(">", "a", "b", "c").alias("path")))


def first_entities(mentions: DataFrame, key: str, n: int = 25) -> DataFrame:
    w = W.partitionBy(key).orderBy("pos", "id")
    return mentions.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")
