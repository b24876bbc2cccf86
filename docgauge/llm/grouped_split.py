"""Splits that keep all records of a document, and of linked documents, together.

Records and the entities they mention form a bipartite graph.  The smallest
label is propagated over it until nothing changes; what ends with the same
label is one group.  Groups are then assigned to splits so that sizes and the
mix of labels come near the targets.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgauge.operators.skewed import SALT, hot_keys, lookup
from docgauge.session import cut, discard

# Full-width digits and letters and their plain forms.
_WIDE = "０１２３４５６７８９ａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺ"
_PLAIN = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Four letters and four digits, as written, misread or framed by other text.
_WRITTEN = r"(?<![a-z0-9])([a-z]{4})[\s_\-]?([0-9oli]{4})(?![a-z0-9])"
_INVISIBLE = r"[\u00AD\u200B-\u200F\u2060\uFEFF]"

#: Labels of documents without a canonical id sort after all canonical ids.
_NAMELESS = "~"
_OFFSET = str(2**63)


def canonical_id(written: Column) -> Column:
    """The canonical document id that ``written`` stands for, or null.

    Case, width, invisible characters, a separator, a prefix or suffix and
    letters misread for digits do not matter.
    """
    plain = F.lower(F.translate(F.regexp_replace(written, _INVISIBLE, ""), _WIDE, _PLAIN))
    letters = F.regexp_extract(plain, _WRITTEN, 1)
    digits = F.translate(F.regexp_extract(plain, _WRITTEN, 2), "oli", "011")
    return F.when(letters != "", F.concat(letters, digits))


def nameless(doc_id: Column) -> Column:
    """The label of a document known by its number only; sorts by number."""
    shifted = doc_id.cast("decimal(20,0)") + F.lit(_OFFSET).cast("decimal(20,0)")
    return F.when(doc_id.isNotNull(), F.concat(F.lit(_NAMELESS), F.lpad(shifted.cast("decimal(20,0)").cast("string"), 20, "0")))


def group_name(label: Column) -> Column:
    number = F.substring(label, 2, 20).cast("decimal(20,0)") - F.lit(_OFFSET).cast("decimal(20,0)")
    return F.when(label.startswith(_NAMELESS), F.concat(F.lit("doc:"), number.cast("long").cast("string"))).otherwise(label)


def documents_of(rows: DataFrame, names: DataFrame) -> DataFrame:
    """``rows`` with ``document``: the own canonical id, else that of ``doc_id``, else the number.

    ``names`` has one canonical id for each ``doc_id`` that has any.
    """
    own = rows.where(F.col("own").isNotNull()).withColumn("document", F.col("own"))
    rest = lookup(rows.where(F.col("own").isNull()), names, "doc_id", spread=["doc_id", *[c for c in rows.columns if c not in ("own", "doc_id")]]).drop(SALT)
    rest = rest.withColumn("document", F.coalesce("name", nameless(F.col("doc_id")))).drop("name")
    return own.unionByName(rest)


def linked_groups(mentions: DataFrame, record: str, entity: str, *, rounds: int = 64) -> DataFrame:
    """(``record``, ``label``): the smallest record reachable over shared entities.

    Only records that share an entity with another one are in the result; for
    all others the label is the record itself.  Mentions with a null on either
    side link nothing; repeated mentions count once.  In every round the
    labels that fell in the round before, and no others, go to the records
    that share an entity, and records that bear such a label take the label of
    their label, so long chains close in few rounds.  When none falls any more,
    each record has heard the label of all its neighbours.  No group is ever
    collected: rounds are minima with partial aggregation, and lookups spread
    the rows of hot entities and records.
    """
    edges = mentions.where(F.col(record).isNotNull() & F.col(entity).isNotNull()).select(F.col(record).alias("r"), F.col(entity).alias("e"))
    edges = edges.groupBy("r", "e").agg(F.lit(1).alias("one")).drop("one")
    shared = edges.groupBy("e").agg(F.min("r").alias("low"), F.max("r").alias("high")).where(F.col("low") != F.col("high")).select("e", "low")
    edges = cut(lookup(edges, shared, "e", spread=["r"], how="inner").select("r", "e", "low"))
    hot_records, hot_entities = (hot_keys(edges, k) for k in ("r", "e"))
    labels = cut(edges.groupBy("r").agg(F.min("low").alias("label")).select("r", F.col("r").alias("was"), "label"))
    edges = edges.select("r", "e")
    for _ in range(rounds):
        fallen = labels.where(F.col("label") < F.col("was")).select("r", "label")
        if fallen.isEmpty():
            return labels.select(F.col("r").alias(record), "label")
        by_entity = lookup(edges, fallen, "r", spread=["e"], hot=hot_records, how="inner").groupBy("e").agg(F.min("label").alias("label"))
        near = lookup(edges, by_entity, "e", spread=["r"], hot=hot_entities, how="inner").groupBy("r").agg(F.min("label").alias("near"))
        met = labels.select("r", F.col("label").alias("was")).join(near, "r", "left").select("r", "was", F.least("was", "near").alias("met"))
        up = fallen.select(F.col("r").alias("met"), F.col("label").alias("up"))
        jumped = lookup(met, up, "met", spread=["r"], hot=hot_keys(labels, "label"))
        new = cut(jumped.select("r", "was", F.least("met", "up").alias("label")))
        discard(labels)
        labels = new
    raise RuntimeError(f"labels still change after {rounds} rounds")


def document_groups(manifest: DataFrame, records: DataFrame) -> DataFrame:
    """(``question_id``, ``label``) for each distinct question of ``records``.

    The label is the smallest document of the question's group.  Questions
    without any document id form groups of their own: their label is null.
    """
    own = canonical_id(F.col("ucsf_document_id"))
    pages = manifest.select("doc_id", own.alias("own"), "source_image_sha256").distinct()
    names = pages.where(F.col("own").isNotNull()).groupBy("doc_id").agg(F.min("own").alias("name"))
    images = F.when(F.trim("source_image_sha256") != "", F.col("source_image_sha256"))
    mentions = documents_of(pages.withColumn("image", images).drop("source_image_sha256"), names)
    groups = linked_groups(mentions, "document", "image")
    asked = records.where(F.col("question_id").isNotNull()).groupBy("question_id", "doc_id", own.alias("own")).agg(F.lit(1).alias("one")).drop("one")
    placed = lookup(documents_of(asked, names), groups, "document", spread=["question_id"])
    return placed.groupBy("question_id").agg(F.min(F.coalesce("label", "document")).alias("label"))


# --- assignment of groups to splits -------------------------------------------------

#: Labels that are balanced by themselves: the most frequent ones; the rest are one more.
STRATA = 31
#: Groups with equal counts of all labels are a class.  Classes that hold more
#: than this part of all records, so fewer than its inverse, are placed with
#: regard to what is placed already.
CLASS_PART = 1 / 4096


def _quotas(classes: list[tuple[np.ndarray, int]], targets: np.ndarray, filled: np.ndarray) -> list[np.ndarray]:
    """How many groups of each class go to each split.

    ``classes`` are (labels of one group, groups), ``targets`` and ``filled``
    records by split and label.  Classes of larger groups come first.  A class
    is divided as its labels are still wanted; the groups left over by
    rounding go, one by one, where the squared distance to the targets grows
    least.  The same rule holds for one large group and for a million small ones.
    """
    filled = filled.astype(float)
    strata = np.maximum(1.0, targets.sum(axis=0))
    total = max(1.0, targets.sum())
    quotas: list[np.ndarray] = [np.zeros(len(targets), dtype=np.int64)] * len(classes)
    for c in sorted(range(len(classes)), key=lambda c: (-classes[c][0].sum(), tuple(classes[c][0]))):
        mix, groups = classes[c]
        wanted = np.maximum(0.0, targets - filled)
        parts = (wanted / np.maximum(1e-9, wanted.sum(axis=0))) @ mix
        quota = np.floor(groups * parts / parts.sum() + 1e-9).astype(np.int64) if parts.sum() > 0 else np.zeros(len(targets), dtype=np.int64)
        filled += quota[:, None] * mix
        for _ in range(groups - int(quota.sum())):
            before, after = filled - targets, filled + mix - targets
            by_label = ((after**2 - before**2) / strata).sum(axis=1)
            by_size = (after.sum(axis=1) ** 2 - before.sum(axis=1) ** 2) / total
            k = int(np.argmin(by_label + len(strata) * by_size))
            filled[k] += mix
            quota[k] += 1
        quotas[c] = quota
    return quotas


def assign_splits(records: DataFrame, shares: list[tuple[str, float]], *, group: str, stratum: str, seed: int = 7) -> DataFrame:
    """``records`` with ``split_name``; all records of a ``group`` get the same one.

    Labels are the ``STRATA`` most frequent values of ``stratum`` and one for
    all others.  Groups with equal counts of labels are a class; a class is
    divided so that sizes and label mix of the splits come nearest to the
    targets (:func:`_quotas`), and its groups are taken in a seeded order.
    Classes too rare to be listed, each below ``CLASS_PART`` of all records,
    are divided by the shares within their main label, and those that are
    listed make up for what that leaves uneven.  What is listed or broadcast is
    bounded by these two constants.

    Null groups are one group, null strata one stratum; ties are broken by the
    group's name; an empty table gives an empty result.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("?"))
    named = records.select(key.alias("__group"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("__stratum"))
    most = named.groupBy("__stratum").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "__stratum").limit(STRATA).collect()
    at = F.array_position(F.array(*[F.lit(r["__stratum"]) for r in most]) if most else F.array(F.lit("")), F.col("__stratum"))
    mix = F.array(*[F.count_if(F.col("at") == i) for i in range(len(most) + 1)])
    groups = cut(named.select("__group", at.alias("at")).groupBy("__group").agg(mix.alias("mix"), F.count(F.lit(1)).alias("size")))
    weights = groups.groupBy("mix").agg(F.count(F.lit(1)).alias("groups"), F.sum("size").alias("weight"))
    labels = groups.agg(F.array(*[F.sum(F.col("mix")[i]) for i in range(len(most) + 1)])).first()[0]
    total = sum(n or 0 for n in labels)
    listed = weights.where(F.col("weight") > total * CLASS_PART).orderBy("mix").collect()
    spark = records.sparkSession
    numbers = spark.createDataFrame([(r["mix"], i) for i, r in enumerate(listed)], "mix array<long>, number int")
    main = -F.array_position("mix", F.array_max("mix")).cast("int")
    # the rank of a group in its class, in a seeded order: over hashed buckets, so that no task sorts a class
    placed = groups.join(F.broadcast(numbers), "mix", "left").withColumn("number", F.coalesce("number", main))
    placed = placed.withColumn("spot", F.xxhash64(F.lit(seed), F.col("__group"))).withColumn("bucket", F.shiftrightunsigned("spot", 52))
    inside = F.row_number().over(Window.partitionBy("number", "bucket").orderBy("spot", "__group")) - 1
    buckets = placed.groupBy("number", "bucket").agg(F.count(F.lit(1)).alias("n"))
    buckets = buckets.select("number", "bucket", (F.sum("n").over(Window.partitionBy("number").orderBy("bucket")) - F.col("n")).alias("start"))
    ranked = placed.withColumn("inside", inside).join(buckets, ["number", "bucket"])
    ranked = cut(ranked.select("__group", "number", "mix", (F.col("start") + F.col("inside")).alias("rank")))
    edges = np.r_[0.0, np.cumsum([share for _, share in shares])] / (sum(share for _, share in shares) or 1.0)
    rare = {r["number"]: r["n"] for r in ranked.where(F.col("number") < 0).groupBy("number").agg(F.count(F.lit(1)).alias("n")).collect()}
    bounds = [(c, name, int(np.rint(low * n)), int(np.rint(high * n))) for c, n in rare.items() for (name, _), low, high in zip(shares, edges, edges[1:])]
    kind = "number int, split_name string, low long, high long"
    taken = (F.col("low") <= F.col("rank")) & (F.col("rank") < F.col("high"))
    sums = ranked.join(F.broadcast(spark.createDataFrame(bounds, kind)), "number").where(taken)
    sums = {r["split_name"]: r["mix"] for r in sums.groupBy("split_name").agg(F.array(*[F.sum(F.col("mix")[i]) for i in range(len(most) + 1)]).alias("mix")).collect()}
    targets = np.outer(np.diff(edges), [n or 0 for n in labels])
    filled = np.array([sums.get(name, [0] * (len(most) + 1)) for name, _ in shares])
    for c, quota in enumerate(_quotas([(np.array(r["mix"]), r["groups"]) for r in listed], targets, filled)):
        ends = np.cumsum(quota)
        bounds += [(c, name, int(end - n), int(end)) for (name, _), n, end in zip(shares, quota, ends)]
    # no more rows than classes are listed, times splits
    chosen = ranked.join(F.broadcast(spark.createDataFrame(bounds, kind)), "number").where(taken).select("__group", "split_name")
    own = [c for c in records.columns if c != "split_name"]
    return lookup(records.select(*own, key.alias("__group")), chosen, "__group", spread=own).select(*[F.col(f"`{c}`") for c in own], "split_name")
