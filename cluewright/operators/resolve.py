"""Entity resolution: normal forms, shared strong evidence, prefix and fuzzy candidates, canonical names.

records have name, the strong evidence columns, source_row_id and ord, the
order of arrival, which decides ties. Merging follows evidence alone; prefixes
and similar spellings only flag clusters for a person to review.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..plans.components import components
from ..plans.ranking import ranked
from ..plans.storage import stored
from .disposal import accepted_names, decided, rejected_names, review_queue

ORG_KEYS, PERSON_KEYS = ["credit_code", "legal_rep", "address", "account"], ["phone"]
LEAST_ORG_CORE, LEAST_PERSON_CORE = 4, 2


def harvest(tables: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """(name, source, ord) of distinct names in (label, table, column) triples; a name's source is the first triple that has it."""
    rows = None
    for i, (label, df, column) in enumerate(tables):
        if column not in df.columns:
            continue
        part = df.select(F.col(column).cast("string").alias("name")).where("name is not null").distinct().select("name", F.lit(f"{label}.{column}").alias("source"), F.lit(i).alias("ord"))
        rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        raise ValueError("none of the tables has its column")
    return rows.groupBy("name").agg(F.min_by("source", "ord").alias("source"), F.min("ord").alias("ord"))


def prepared(records: DataFrame, keys: list[str], core: str, aliases: DataFrame | None, unicode: bool) -> DataFrame:
    """Records with a name, a comparable core (by alias where one is known) and comparable evidence."""
    form = {"org": N.org_core, "person": N.person_core}[core]
    out = records.select(
        "name",
        *[N.attribute(F.col(k) if k in records.columns else F.lit(None), unicode).alias(k) for k in keys],
        (F.col("source_row_id") if "source_row_id" in records.columns else F.lit("")).cast("string").alias("source_row_id"),
        F.col("ord").cast("long").alias("ord"),
        form(F.col("name"), unicode).alias("core"),
    ).where(N.attribute(F.col("name"), False) != "")
    if aliases is None:
        return out.select("*", F.lit(None).cast("string").alias("given"))
    known = aliases.select(form(F.col("variant"), unicode).alias("core"), form(F.col("canonical"), unicode).alias("to"), F.col("canonical").alias("given"))
    known = known.unionByName(aliases.select(form(F.col("canonical"), unicode).alias("core"), form(F.col("canonical"), unicode).alias("to"), F.col("canonical").alias("given")))
    known = known.groupBy("core").agg(F.min(F.struct("to", "given")).alias("k")).select("core", "k.to", "k.given")
    return out.join(known, "core", "left").select("name", *keys, "source_row_id", "ord", F.coalesce("to", "core").alias("core"), "given")


def _canonical(freq: DataFrame, by: str) -> DataFrame:
    """Per cluster the name that has CJK letters, is most frequent, shortest, first; what is still equal is decided by the name."""
    order = F.struct(F.col("name").rlike(N.CJK).alias("a"), F.col("n").alias("b"), (-F.char_length("name")).alias("c"), (-F.col("first")).alias("d"), F.col("name").alias("e"))
    return freq.groupBy(by).agg(F.max_by("name", order).alias("canonical"))


def clusters(records: DataFrame, keys: list[str], kind: str = "org", aliases: DataFrame | None = None, unicode: bool = True) -> DataFrame:
    """(entity_id, canonical, variants, <key>s, source_rows, confidence, needs_review, cluster).

    Names of one core are a group; groups that share a value of one strong key
    are linked, and linked groups are one cluster. A merged cluster, or one
    with strong evidence, an alias or a single spelling, has confidence 1.0,
    the others 0.9 and need review.
    """
    rows = stored(prepared(records, keys, kind, aliases, unicode), "records")
    # Group and evidence value are the two sides of a bipartite graph: links are as many as records, not pairs.
    ends = None
    for k in keys:
        part = rows.where(F.col(k) != "").select(F.concat(F.lit("c:"), "core").alias("u"), F.concat(F.lit(f"k:{k}:"), k).alias("v")).distinct()
        ends = part if ends is None else ends.union(part)
    label = components(ends).where(F.col("vertex").startswith("c:")).select(F.expr("substring(vertex, 3)").alias("core"), F.expr("substring(component, 3)").alias("cluster"))
    placed = stored(rows.join(label.hint("merge"), "core", "left").withColumn("cluster", F.coalesce("cluster", "core")), "placed")
    freq = placed.groupBy("cluster", "core", "name").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"), F.max("given").alias("given"))
    groups = placed.groupBy("cluster").agg(F.count_distinct("core").alias("groups"), F.max(F.col("given").isNotNull()).alias("known"), F.count_distinct("name").alias("spellings"))
    canonical = _canonical(freq.groupBy("cluster", "name").agg(F.sum("n").alias("n"), F.min("first").alias("first")), "cluster")
    # A group's canonical name counts among its spellings, unless a merge picks from records alone.
    with_given = freq.select("cluster", "name", "n", "first").unionByName(freq.where("given is not null").select("cluster", F.col("given").alias("name"), F.lit(1).cast("long").alias("n"), F.lit(1 << 40).alias("first")).distinct())
    alone = _canonical(with_given.groupBy("cluster", "name").agg(F.max("n").alias("n"), F.min("first").alias("first")), "cluster").withColumnRenamed("canonical", "alone")
    evidence = placed.groupBy("cluster").agg(
        F.array_sort(F.collect_set("name")).alias("variants"),
        *[F.array_sort(F.collect_set(F.when(F.col(k) != "", F.col(k)))).alias(f"{k}s") for k in keys],
        F.array_sort(F.collect_set(F.when(F.col("source_row_id") != "", F.col("source_row_id")))).alias("source_rows"),
    )
    strong = F.lit(False)
    for k in keys:
        strong = strong | (F.size(f"{k}s") > 0)
    out = evidence.join(groups, "cluster").join(canonical, "cluster").join(alone, "cluster")
    name = F.when(F.col("groups") > 1, F.col("canonical")).otherwise(F.col("alone"))
    out = out.withColumn("canonical", name).withColumn("confidence", F.when(strong | F.col("known") | (F.col("spellings") == 1) | (F.col("groups") > 1), 1.0).otherwise(0.9))
    return out.select(N.entity_id(kind, F.col("canonical")).alias("entity_id"), "canonical", "variants", *[f"{k}s" for k in keys], "source_rows", "confidence", (F.col("confidence") < 1.0).alias("needs_review"), "cluster")


def prefix_pairs(cores: DataFrame, least: int, within: list[str] | None = None) -> DataFrame:
    """(within, a, b): a, at least least letters long, is a proper prefix of b, of those that agree in the columns within. cores has core.

    Each core is joined to its own prefixes: an equi-join with as many rows as
    letters, in place of comparing all with all.
    """
    by = within or []
    distinct = cores.select(*by, "core").distinct()
    prefixes = distinct.where(F.char_length("core") > least).select(*by, F.col("core").alias("b"), F.explode(F.transform(F.sequence(F.lit(least), F.char_length("core") - 1), lambda n: F.substring(F.col("core"), F.lit(1), n))).alias("core"))
    return prefixes.join(distinct.hint("merge"), [*by, "core"]).select(*by, F.col("core").alias("a"), "b")


def _most_edits(length: Column, threshold: float) -> Column:
    """Edits that the longer string's length bounds."""
    return F.floor((1 - threshold) * length + 1e-9).cast("int")


def _one_letter_apart(distinct: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Groups of cores one edit apart, of those whose lengths allow one: (at, rest, many), cores that differ in the letter at alone; and (rest, whole, many), a core and those that become it by losing one letter. distinct has core.

    Each core is written once for each of its letters and meets none that is
    two edits away.
    """
    n = F.char_length("core")
    without = lambda at: F.concat(F.expr("substring(core, 1, at - 1)"), F.expr("substring(core, at + 1)")).alias("rest")
    one = lambda length: (_most_edits(length, threshold) == 1) & (1 - 1 / length >= threshold)
    cut = distinct.where(one(n)).select("core", F.explode(F.sequence(F.lit(1), n)).alias("at")).select("core", "at", without("at"))
    same = cut.groupBy("at", "rest").agg(F.collect_list("core").alias("many")).where(F.size("many") > 1)
    whole = distinct.where(one(n + 1)).select(F.col("core").alias("rest"), F.col("core").alias("whole"), F.lit(None).cast("string").alias("core"))
    both = whole.unionByName(cut.select("rest", F.lit(None).cast("string").alias("whole"), "core"))
    longer = both.groupBy("rest").agg(F.max("whole").alias("whole"), F.collect_set("core").alias("many")).where(F.col("whole").isNotNull() & (F.size("many") > 0))
    return same, longer

def _pieces_meet(distinct: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity), a < b, as fuzzy_pairs(), of those whose lengths allow two edits or more. distinct has core."""
    n = F.char_length("core")
    most = lambda length: _most_edits(length, threshold)
    longest = F.floor(n / threshold + 1e-9).cast("int")
    # The shorter string has at least threshold of the longer one's letters.
    short = distinct.select(F.col("core").alias("a"), n.alias("na"), F.explode(F.sequence(n, longest)).alias("nb")).withColumn("d", most(F.col("nb"))).where("d > 1")
    cut = lambda i: F.floor(i * F.col("na") / (F.col("d") + 1)).cast("int")
    short = short.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("d"))))
    short = short.select("a", "na", "nb", cut(F.col("i")).alias("at"), F.expr("substring(a, cast(floor(i * na / (d + 1)) as int) + 1, cast(floor((i + 1) * na / (d + 1)) as int) - cast(floor(i * na / (d + 1)) as int))").alias("piece"))
    long = distinct.select(F.col("core").alias("b"), n.alias("nb")).withColumn("d", most(F.col("nb"))).where("d > 1")
    long = long.withColumn("na", F.explode(F.sequence(F.ceil(F.col("nb") * threshold - 1e-9).cast("int"), F.col("nb")))).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("d"))))
    long = long.withColumn("at", cut(F.col("i"))).withColumn("shift", F.explode(F.sequence(-F.col("d"), F.col("d")))).where("at + shift >= 0 and at + shift <= nb")
    long = long.select("b", "na", "nb", "at", F.expr("substring(b, at + shift + 1, cast(floor((i + 1) * na / (d + 1)) as int) - at)").alias("piece")).distinct()
    pairs = short.join(long.hint("merge"), ["na", "nb", "at", "piece"]).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs.withColumn("similarity", _similarity()).where(F.col("similarity") >= threshold)


def _similarity() -> Column:
    return 1 - F.levenshtein("a", "b") / F.greatest(F.char_length("a"), F.char_length("b"))


def fuzzy_pairs(cores: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(a, b, similarity), a < b: 1 - edit distance / longer length of threshold or more.

    Lossless blocking: cores one edit apart share what is left without one
    letter, and meet those alone, so that numbered names do not all meet. Of
    d > 1 edits one of d + 1 pieces of the shorter string stays whole, at most
    d letters from its place: every core is cut into pieces for each d that
    its length allows, and pieces are joined to the places where they may
    stand in the other.
    """
    distinct = cores.select("core").distinct().where(F.char_length("core") > 0)
    same, longer = _one_letter_apart(distinct, threshold)
    one = same.select("many", F.explode("many").alias("a")).select("a", F.explode("many").alias("b")).where("a < b")
    one = one.unionByName(longer.select("whole", F.explode("many").alias("core")).select(F.least("whole", "core").alias("a"), F.greatest("whole", "core").alias("b")))
    return one.withColumn("similarity", _similarity()).unionByName(_pieces_meet(distinct, threshold))


def fuzzy_cores(cores: DataFrame, threshold: float, least: int) -> DataFrame:
    """(core,): those of fuzzy_pairs() whose longer one has least letters, each once or more. Pairs one edit apart, of which numbered names have very many, are not listed."""
    distinct = cores.select("core").distinct().where(F.char_length("core") > 0)
    same, longer = _one_letter_apart(distinct, threshold)
    one = same.select(F.explode("many").alias("core")).where(F.char_length("core") >= least)
    one = one.unionByName(longer.where(F.char_length("whole") + 1 >= least).select(F.explode(F.concat(F.array("whole"), "many")).alias("core")))
    rest = _pieces_meet(distinct, threshold).where(F.greatest(F.char_length("a"), F.char_length("b")) >= least)
    return one.unionByName(rest.select(F.explode(F.array("a", "b")).alias("core")))


def flagged(found: DataFrame, kind: str = "org", threshold: float = 0.85, unicode: bool = True) -> DataFrame:
    """clusters() with needs_review also set where a canonical name is a prefix of another's or, for persons, spelt like it, and for organisations where spellings of one cluster extend each other."""
    form, least = (N.org_core, LEAST_ORG_CORE) if kind == "org" else (N.person_core, LEAST_PERSON_CORE)
    cores = stored(found.select("cluster", form(F.col("canonical"), unicode).alias("core")), "cores")  # read for every length and edit
    near = prefix_pairs(cores, least).select(F.explode(F.array("a", "b")).alias("core"))
    if kind == "person":
        near = near.unionByName(fuzzy_cores(cores, threshold, least))
    marked = near.distinct().join(cores.hint("merge"), "core").select("cluster")
    if kind == "org":
        own = found.select("cluster", F.explode("variants").alias("name")).select("cluster", form(F.col("name"), unicode).alias("core")).distinct()
        marked = marked.union(prefix_pairs(own, least, ["cluster"]).select("cluster"))
    marked = marked.distinct().withColumn("mark", F.lit(True))
    return found.join(marked.hint("merge"), "cluster", "left").withColumn("needs_review", F.col("needs_review") | F.coalesce("mark", F.lit(False))).drop("mark")


def mapping(found: DataFrame, rejected: DataFrame | None = None) -> DataFrame:
    """(name, canonical) of clusters of confidence 1.0, without names that a reviewer rejected."""
    out = found.where("confidence >= 1.0").select(F.explode("variants").alias("name"), "canonical")
    return out if rejected is None else out.join(rejected.select("name").distinct(), "name", "left_anti")


def write_back(df: DataFrame, columns: list[str], names: DataFrame) -> DataFrame:
    """df with canonical_<column> for each column it has: the canonical name, or the name itself where none is known."""
    one = names.groupBy("name").agg(F.min("canonical").alias("canonical"))
    for c in columns:
        if c in df.columns:
            own = one.select(F.col("name").alias(f"__{c}"), F.col("canonical").alias(f"canonical_{c}"))
            df = df.join(own.hint("merge"), F.col(c) == F.col(f"__{c}"), "left").drop(f"__{c}").withColumn(f"canonical_{c}", F.coalesce(f"canonical_{c}", F.col(c)))
    return df


def report(found: DataFrame) -> DataFrame:
    """One row: clusters, merged spellings, strong merges, candidates for review."""
    strong: Column = (F.col("confidence") >= 1.0) & (F.size("variants") > 1)
    return found.agg(
        F.count(F.lit(1)).alias("clusters"),
        F.coalesce(F.sum(F.size("variants") - 1), F.lit(0)).cast("long").alias("merged"),
        F.coalesce(F.sum(strong.cast("long")), F.lit(0)).alias("strong_merges"),
        F.coalesce(F.sum(F.col("needs_review").cast("long")), F.lit(0)).alias("review"),
    )


def by_confidence(found: DataFrame) -> DataFrame:
    """Clusters with their place in a list, the surest first."""
    return ranked(found, [F.desc("confidence"), F.asc("entity_id"), F.asc("cluster")], "place")


def align(people: DataFrame, firms: DataFrame, person_aliases: DataFrame | None = None, org_aliases: DataFrame | None = None, decisions: DataFrame | None = None) -> dict[str, DataFrame]:
    """Persons and organisations resolved in one go, reviewed and mapped.

    people and firms are records as in clusters(). What comes back: persons and
    organisations, flagged; review, the candidates of both with decisions put
    in (candidate_id, decision, operator, note); names, (name, canonical) of
    sure clusters and of accepted candidates without what was rejected; report,
    a row for each kind.
    """
    out, queue, known, told = {}, None, None, None
    for name, kind, records, keys, aliases in (("persons", "person", people, PERSON_KEYS, person_aliases), ("organisations", "org", firms, ORG_KEYS, org_aliases)):
        found = stored(flagged(stored(clusters(records, keys, kind, aliases), "clusters"), kind), name)
        out[name] = found
        parts = review_queue(found, kind), found, report(found).withColumn("kind", F.lit(kind))
        queue, told = (parts[0], parts[2]) if queue is None else (queue.unionByName(parts[0]), told.unionByName(parts[2]))
        sure = mapping(found)
        known = sure if known is None else known.unionByName(sure)
    queue = queue.withColumn("operator", F.lit(None).cast("string")).withColumn("note", F.lit(None).cast("string")) if decisions is None else decided(queue, decisions)
    out["review"] = stored(queue, "review")
    names = known.unionByName(accepted_names(out["review"])).join(rejected_names(out["review"]).distinct(), "name", "left_anti")
    return out | {"names": names.groupBy("name").agg(F.min("canonical").alias("canonical")), "report": told}
