"""N-gram Jaccard join by set-relation skipping (operator 6).

Each text becomes its set of word shingles. Equal sets are one set from the start. An inverted
index holds, for every shingle in a set's prefix (rare shingles first; two sets with Jaccard
similarity t share a prefix shingle), a list of (set, size, position).

Sets first meet the leader of each of their lists only, the set that a hash puts first. The
differences to a leader that is similar are kept; the sets with one leader are a group. Highly
similar leaders come first, but distant ones are better than none: what a set has in common with
many others then lies in the reference, and only its differences are looked up.

* Answer skipping: within a group, what a set links with follows from differences alone. Against
  any one reference set, |x ^ y| = |dx| + |dy| - 2 |dx & dy|; the reference is the leader with the
  shingles flipped in which most of the group differs from it. With e = |d| - u |x| and
  u = (1 - t) / (1 + t), x and y link if e(x) + e(y) <= 2 |dx & dy|. So sets that link without
  common differences link with the set of the least e, too, and all others share one of the first
  shingles of their differences (rarest first). An index over those finds them, again with leaders
  of lists first: a set takes over the class of the leader it links with, and later visits skip
  what has one class already. Lists over whole sets are not looked at within a group.
* Index skipping: across groups, a list is cut into blocks by size class and position. A set only
  visits the blocks whose sizes and positions can reach t, the largest group of a list never visits
  itself, and pairs whose prefixes share too few shingles are passed over before any set is compared.

Defined results: null or word-free texts have an empty set, size 0, and link with nothing; fewer
than ``width`` words are one shingle; rows with a null doc_id have a null component and link with
nothing; rows that repeat a doc_id count as one document with several texts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerframe.llm.common import bitmap_of, forget, in_bitmap, lower_ascii, stored, words
from ledgerframe.llm.components import components, linked

#: A leader is highly similar from this similarity on, in percent.
RELATED = 60

#: A set without such a leader joins the group of one that has this similarity at least: it shares
#: that group's frequent shingles, and would visit all of its sets otherwise.
LOOSE = 40


def shingles(text: Column, width: int) -> Column:
    """Sorted distinct 64-bit hashes of the shingles."""

    def of(w: Column) -> Column:
        n = F.size(w)
        hashed = F.transform(F.sequence(F.lit(0), F.greatest(n - width, F.lit(0))), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))
        return F.when(n > 0, F.sort_array(F.array_distinct(hashed))).otherwise(F.array().cast("array<bigint>"))

    return F.element_at(F.transform(F.array(words(lower_ascii(text))), of), 1)


def _prefix_length(n: Column, percent: int) -> Column:
    return F.when(n > 0, n - F.ceil(n * percent / 100).cast("int") + 1).otherwise(0)


def _counted_below(percent: int) -> int:
    """Shingles with a hash below this are counted: some 1.5 times as many of each set as its prefix takes."""
    return -(2**63) + min(int(1.5 * (100 - percent) / 100 * 2**64), 2**64 - 1)


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """Index entries (sid, n, pos, token): the prefix shingles that another set may have in its own.

    One order of shingles for all sets: the counted ones by the number of sets that have them, then
    by hash; the others after them by hash. ``first`` holds what that order needs: all counted
    shingles (``counted`` many), more if the prefix is longer. A shingle that one set has alone is
    no entry, but takes its place in the order. A set holds a shingle once, so no shingle has more
    entries than there are sets.
    """
    listed = sets.select("sid", "d1", "n", "counted", F.posexplode("first").alias("i", "token"))
    common = listed.withColumn("k", F.count("*").over(Window.partitionBy("token"))).filter("k > 1")
    late = F.col("i") >= F.col("counted")
    place = F.struct(late.alias("late"), F.when(late, F.col("i").cast("long")).otherwise(F.col("k")).alias("by"), "token", "i")
    ranked = common.groupBy("sid", "d1").agg(F.first("n").alias("n"), (F.first("counted") - F.sum((~late).cast("int"))).alias("alone"), F.sort_array(F.collect_list(place)).alias("ranked"))
    entries = ranked.select("sid", "n", "alone", F.posexplode("ranked").alias("j", "x"))
    pos = F.when(F.col("x.late"), F.col("x.i") + 1).otherwise(F.col("alone") + F.col("j") + 1)
    return entries.select("sid", "n", pos.alias("pos"), F.col("x.token").alias("token")).filter(F.col("pos") <= _prefix_length(F.col("n"), percent))


def _texts_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """(sid, text) of the documents in ``ids``; a bitmap of their hashes saves moving most others."""
    ids = stored(ids.distinct(), "ids")
    near = docs.filter(in_bitmap(F.xxhash64("doc_id"), bitmap_of(ids.select(F.xxhash64("sid")))))
    return near.withColumnRenamed("doc_id", "sid").join(ids, "sid", "left_semi")


def _size_class(n: Column, percent: int) -> Column:
    return F.floor(F.log(n.cast("double")) / -math.log(percent / 100) + 1e-9).cast("int") if percent < 100 else n


def _similar(percent: int) -> Column:
    """Sizes na, nb and the number of common shingles give the similarity."""
    return 100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common"))


def _led_much(met: DataFrame, index: DataFrame) -> DataFrame:
    """Pairs (a, b) of a set and a leader of much of what it has in lists: worth comparing, links or not."""
    least = F.least("la", "lb") * 0.15
    pairs = met.groupBy("a", "b").agg(F.count("*").alias("shared"), F.max(least).alias("least")).filter("shared >= least - 1e-6")
    listed = index.groupBy(F.col("sid").alias("a")).agg(F.count("*").alias("listed"))
    return pairs.join(listed, "a").filter("shared >= listed * 0.4 - 1e-6").select("a", "b")


def _likely(pairs: DataFrame, index: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b, na, nb) that share enough of their prefixes.

    What two sets share lies in both prefixes, or after the end of one.
    """
    prefixes = index.groupBy("sid").agg(F.collect_set("token").alias("prefix"))
    both = pairs.join(prefixes.select(F.col("sid").alias("a"), F.col("prefix").alias("ta")), "a").join(prefixes.select(F.col("sid").alias("b"), F.col("prefix").alias("tb")), "b")
    length_a, length_b = _prefix_length(F.col("na"), percent), _prefix_length(F.col("nb"), percent)
    least = percent * (F.col("na") + F.col("nb")) / (100 + percent) - F.greatest(F.col("na") - length_a, F.col("nb") - length_b)
    return both.filter(F.size(F.array_intersect("ta", "tb")) >= least - 1e-6).select("a", "b").distinct()


def _full_sets(pairs: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(sid, s): the whole sets of all documents in ``pairs``."""
    return stored(_texts_of(pairs.select(F.explode(F.array("a", "b")).alias("sid")), docs).select("sid", shingles(F.col("text"), width).alias("s")), "full")


def _compared(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """The pairs with both whole sets (columns sa, sb) and the size of their intersection."""
    both = pairs.join(full.select(F.col("sid").alias("a"), F.col("s").alias("sa")), "a").join(full.select(F.col("sid").alias("b"), F.col("s").alias("sb")), "b")
    return both.select("a", "b", "sa", "sb", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("common"))


def jaccard_components(docs: DataFrame, percent: int = 90, width: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id): one row for each row of ``docs``.

    Documents link when ``100 * intersection >= percent * union``; component_id is the smallest
    doc_id reachable by links, the own one included.
    """
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    whole = base.select("doc_id", shingles(F.col("text"), width).alias("s")).withColumn("n", F.size("s"))
    # one row for each document: size, 128-bit digest of its set, the shingles that its prefix may take
    whole = whole.withColumn("counted", F.size(F.filter("s", lambda x: x < _counted_below(percent))))
    some = F.slice("s", F.lit(1), F.greatest("counted", _prefix_length(F.col("n"), percent)))
    sets = stored(whole.select("doc_id", "n", "counted", F.xxhash64("s").alias("d1"), F.xxhash64(F.lit(1), "s").alias("d2"), some.alias("first")), "sets")
    with_id = sets.filter("doc_id IS NOT NULL AND n > 0")
    key = ["d1", "d2", "n"]
    same = with_id.groupBy(*key).agg(F.min("doc_id").alias("sid"))
    member = stored(with_id.select("doc_id", *key).join(same, key), "member")
    reps = with_id.join(same.withColumnRenamed("sid", "doc_id"), ["doc_id", *key], "left_semi").dropDuplicates(["doc_id", *key]).withColumnRenamed("doc_id", "sid")
    # the index: prefix shingles that two different sets have at least
    entries = stored(_prefixes(reps, percent), "entries")
    shared = entries.groupBy("token").agg(F.min("sid").alias("lo"), F.max("sid").alias("hi")).filter("lo < hi").select("token")
    index = stored(entries.join(shared, "token", "left_semi").withColumn("block", _size_class(F.col("n"), percent)), "index")
    forget(entries)

    repeated = member.groupBy("doc_id").agg(F.min("sid").alias("b"), F.max("sid").alias("a")).filter("a <> b").select("a", "b")
    pairs = stored(_led_much(_leader_pairs(index, percent), index), "pairs")
    full = _full_sets(pairs, base, width)
    led = _compared(pairs, full).filter(100 * F.col("common") >= min(LOOSE, percent) * (F.col("na") + F.col("nb") - F.col("common")))
    led = stored(led.select("a", "b", "na", "nb", "common", F.concat(F.array_except("sa", "sb"), F.array_except("sb", "sa")).alias("delta")), "led")
    forget(pairs), forget(full)
    links = repeated.union(led.filter(_similar(percent)).select("a", "b"))
    groups = stored(_groups(led, percent), "groups")
    classes = _classes_in_groups(groups, links, percent)
    forget(led)
    known = _open_lists(index, classes, groups)
    met = stored(_pairs_across(known, percent), "met")
    pairs = stored(_likely(met, index, percent), "pairs")
    full = _full_sets(pairs, base, width)
    links = stored(linked(classes).union(_compared(pairs, full).filter(_similar(percent)).select("a", "b")), "links")
    for done in (index, known, met, pairs, full, groups, classes):
        forget(done)
    classes = components(links)

    result = member.join(classes.withColumnRenamed("node", "sid"), "sid", "left").select("doc_id", *key, F.coalesce("component", "sid").alias("component_id")).dropDuplicates(["doc_id", *key])
    return sets.select("doc_id", *key).join(result, ["doc_id", *key], "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _leader_pairs(index: DataFrame, percent: int) -> DataFrame:
    """Each entry (a) with the leader of its list (b), and the lengths of both prefixes."""
    leaders = index.groupBy("token").agg(F.min(F.struct(F.xxhash64("sid").alias("h"), "sid", "n")).alias("lead"))
    leaders = leaders.select("token", F.col("lead.sid").alias("b"), _prefix_length(F.col("lead.n"), percent).alias("lb"))
    return index.select("token", F.col("sid").alias("a"), _prefix_length(F.col("n"), percent).alias("la")).join(leaders, "token").filter("a <> b")


def _groups(led: DataFrame, percent: int) -> DataFrame:
    """(sid, lead, n, e, delta): each set with the first of its highly similar leaders.

    A set that others follow leads itself. ``delta`` is the difference to the group's reference,
    its shingles in order of their frequency in the group.
    """
    loose = 100 * F.col("common") < min(RELATED, percent) * (F.col("na") + F.col("nb") - F.col("common"))
    first = led.groupBy("a").agg(F.min(F.struct(loose.alias("loose"), F.xxhash64("b").alias("h"), F.col("b"))).alias("lead")).select("a", F.col("lead.b").alias("b"))
    chosen = led.join(first, ["a", "b"])
    heads = chosen.groupBy("b").agg(F.max("nb").alias("n"))
    follow = chosen.join(heads.select(F.col("b").alias("a")), "a", "left_anti").select(F.col("a").alias("sid"), F.col("b").alias("lead"), F.col("na").alias("n"), "delta")
    raw = stored(follow.union(heads.select("b", "b", "n", F.array().cast("array<bigint>"))), "raw")
    sizes = raw.groupBy("lead").agg(F.count("*").alias("size"))
    counts = raw.select("lead", F.explode("delta").alias("token")).groupBy("lead", "token").agg(F.count("*").alias("k")).join(sizes, "lead")
    flips = counts.filter("2 * k > size").groupBy("lead").agg(F.collect_list("token").alias("flip"))
    flip = F.coalesce("flip", F.array().cast("array<bigint>"))
    moved = raw.join(flips, "lead", "left").select("sid", "lead", "n", F.concat(F.array_except("delta", flip), F.array_except(flip, "delta")).alias("delta"))
    seen = counts.select("lead", "token", F.when(F.expr("2 * k > size"), F.col("size") - F.col("k")).otherwise(F.col("k")).alias("k"))
    ranked = moved.select("sid", "lead", F.explode("delta").alias("token")).join(seen, ["lead", "token"]).groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("k", "token"))).alias("r"))
    full = moved.drop("delta").join(ranked.select("sid", F.col("r.token").alias("delta")), "sid", "left").withColumn("delta", F.coalesce("delta", F.array().cast("array<bigint>")))
    return full.withColumn("e", F.size("delta") - F.col("n") * ((100 - percent) / (100 + percent)))


def _classes_in_groups(groups: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """(node, component) by ``links`` and, between sets of one group, as many more as give the same classes as all would."""
    hub = groups.groupBy("lead").agg(F.min(F.struct("e", "sid")).alias("hub")).select("lead", F.col("hub.sid").alias("y"), F.col("hub.e").alias("e0"))
    classes = components(links.union(_from_differences(groups.join(hub, "lead").filter("sid <> y").select(F.col("sid").alias("x"), "y"), groups, percent)))
    # sets of different classes share over (e + e0) / 2 shingles of their differences
    least = F.greatest(F.lit(1), F.ceil((F.col("e") + F.col("e0")) / 2 - 1e-6))
    prefix = F.slice("delta", F.lit(1), F.greatest(F.lit(0), F.size("delta") - least + 1).cast("int"))
    lists = groups.join(hub, "lead").select("lead", "sid", "e", F.size("delta").alias("size"), F.posexplode(prefix).alias("i", "token"))
    # what two sets can share at most if this is the first shingle of their differences that they share
    lists = stored(lists.select("lead", "sid", "e", (F.col("size") - F.col("i")).alias("rest"), "token"), "lists")
    able = F.col("e") + F.col("e2") <= 2 * F.least("rest", "rest2") + 1e-6
    key = ["lead", "token"]
    for turn in range(3):
        known = _with_class(lists, classes)
        per = known.groupBy(*key, "class").agg(F.count("*").alias("k"), F.min(F.struct(F.col("e").alias("by") if turn == 0 else F.xxhash64("sid").alias("by"), "sid", "e", "rest")).alias("best"))
        tops = per.groupBy(*key).agg(F.count("*").alias("classes"), F.max(F.struct("k", "class")).alias("top"), F.min("best").alias("best")).filter("classes > 1")
        open_ = known.join(tops.select(*key, F.col("top.class").alias("top"), F.col("best.sid").alias("y"), F.col("best.e").alias("e2"), F.col("best.rest").alias("rest2")), key)
        if turn < 2:
            pairs = open_.filter((F.col("sid") != F.col("y")) & able).select(F.col("sid").alias("x"), "y").distinct()
        else:
            visiting = open_.filter("class <> top").select(*key, F.col("sid").alias("y"), F.col("class").alias("class2"), F.col("e").alias("e2"), F.col("rest").alias("rest2"))
            pairs = open_.drop("y", "e2", "rest2").join(visiting, key).filter(able & (F.col("class") != F.col("class2")) & ((F.col("class") == F.col("top")) | (F.col("sid") < F.col("y")))).select(F.col("sid").alias("x"), "y").distinct()
        found = stored(_from_differences(pairs, groups, percent), "links")
        if not found.isEmpty():
            classes = components(linked(classes).union(found))
    return classes


def _from_differences(pairs: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """The similar ones of pairs (x, y) of one group, from their differences to its leader."""
    a = groups.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("delta").alias("da"))
    b = groups.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("delta").alias("db"))
    apart = F.size("da") + F.size("db") - 2 * F.size(F.array_intersect("da", "db"))
    both = pairs.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct().join(a, "a").join(b, "b")
    return both.withColumn("common", ((F.col("na") + F.col("nb") - apart) / 2).cast("int")).filter(_similar(percent)).select("a", "b")


def _with_class(sets: DataFrame, classes: DataFrame) -> DataFrame:
    known = sets.join(classes.select(F.col("node").alias("sid"), F.col("component").alias("class")), "sid", "left")
    return known.withColumn("class", F.coalesce("class", "sid"))


def _open_lists(index: DataFrame, classes: DataFrame, groups: DataFrame) -> DataFrame:
    """The entries of lists in which different classes and groups meet, with class, group and the list's largest group."""
    known = _with_class(index, classes).join(groups.select("sid", "lead"), "sid", "left").withColumn("group", F.coalesce("lead", "sid")).drop("lead")
    known = stored(known, "known")
    per = known.groupBy("token", "group").agg(F.count("*").alias("k"), F.min("class").alias("lo"), F.max("class").alias("hi"))
    lists = per.groupBy("token").agg(F.count("*").alias("groups"), F.max(F.struct("k", "group")).alias("top"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    lists = lists.filter("groups > 1 AND lo < hi").select("token", F.col("top.group").alias("top"))
    opened = stored(known.join(lists, "token"), "open")
    forget(known)
    return opened


def _late(n: Column, pos: Column, percent: int) -> Column:
    """Whether an entry stands too late to be the first shingle that its set shares with a larger one."""
    return (100 + percent) * (1 + n - pos) < 2 * percent * n


def _pairs_across(open_: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b, na, nb) of different classes and groups whose first shared shingle may be in a list.

    The largest group of a list isn't paired with itself: only the others visit the list's blocks. A
    block holds one size class and is early or late by its entries' positions. The first shingle that
    two similar sets share leaves enough shingles behind it in both; so it is early in the smaller
    one. Late entries skip the late blocks and those of larger sets, early ones the late blocks of
    smaller sets.
    """
    late = _late(F.col("n"), F.col("pos"), percent)
    place = lambda step, late: F.struct((F.col("block") + step).alias("block"), F.lit(late).alias("late"))
    early_too = F.array(place(-1, False), place(0, False), place(1, False), place(0, True), place(1, True))
    blocks = F.when(late, F.array(place(-1, False), place(0, False))).otherwise(early_too)
    visiting = open_.filter("group <> top").select("token", F.explode(blocks).alias("at"), F.col("sid").alias("sid2"), F.col("n").alias("n2"), F.col("pos").alias("pos2"), F.col("class").alias("class2"), F.col("group").alias("group2"))
    visiting = visiting.withColumn("block", F.col("at.block")).withColumn("late", F.col("at.late")).drop("at")
    apart = (F.col("class") != F.col("class2")) & (F.col("group") != F.col("group2"))
    sizes = 100 * F.least("n", "n2") >= percent * F.greatest("n", "n2")
    enough = (100 + percent) * (1 + F.least(F.col("n") - F.col("pos"), F.col("n2") - F.col("pos2"))) >= percent * (F.col("n") + F.col("n2"))
    once = (F.col("group") == F.col("top")) | (F.col("sid") < F.col("sid2"))
    met = open_.withColumn("late", late).join(visiting, ["token", "block", "late"]).filter(apart & sizes & enough & once)
    larger = F.col("sid") > F.col("sid2")
    pair = [F.greatest("sid", "sid2").alias("a"), F.least("sid", "sid2").alias("b"), F.when(larger, F.col("n")).otherwise(F.col("n2")).alias("na"), F.when(larger, F.col("n2")).otherwise(F.col("n")).alias("nb")]
    return met.select(*pair).distinct()
