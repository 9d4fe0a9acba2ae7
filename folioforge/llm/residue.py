"""Template residue, filler and error texts, by label propagation over near-duplicates.

Nodes are all sentences (words of letters, in lower case), those of headings,
titles and noscript notices too.  Edges join nodes that share at least
``LEAST_SIMILAR`` of their words; they are found exactly, by the slots of
:func:`~folioforge.llm.page_profile.prefix_slots`.  Trusted labels come from two
places: default messages of common software, and the corpus itself, where a
sentence stands in bodies of at most ``SOLE_WORDS`` words on ``SOLE_HOSTS`` hosts, and
in such bodies on a good part of all pages that hold it.  Labels spread through
connected components, a ring of neighbours at a time, until a ring brings none
that is new.  A block is residue if it holds a labelled sentence, an unfilled
template field or filler text.  A page is residue as a whole (``block_ord`` -1) if
nothing else stands where its body should be, be it in blocks, headings or a
notice that scripts are required.  A title is residue if a part of it is a
message by its form, is labelled, or is found on residue pages and hardly any other.

Sentences that write about such texts are none.  Null html gives no row;
repeated pages give each row once; texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.boilerplate import Pages, block_marks, field_flag
from folioforge.llm.page_profile import MAIN, NOTICE, SHORT_WORDS, TITLE, TITLE_PART, seeds
from folioforge.sources import keep

#: The slots of prefix_slots are made for this share.
LEAST_SIMILAR = 0.8
#: A sentence that is a message: in bodies of so many words at most, on so many hosts, and so on this share of its pages.
SOLE_WORDS, SOLE_HOSTS, SOLE_SHARE = SHORT_WORDS, 3, 0.2
#: A title part that is a message: on so many hosts, and residue on this share of its pages.
TITLE_HOSTS, TITLE_SHARE = 2, 0.9


def _similar(a: Column, b: Column) -> Column:
    x, y = F.split(a, " "), F.split(b, " ")
    return F.size(F.array_intersect(x, y)) >= LEAST_SIMILAR * F.size(F.array_union(x, y))


def sentences(profile: DataFrame) -> DataFrame:
    """``page_id, host, block_ord, key, slots, folded`` of all sentences, once for each delivery of a page."""
    rows = profile.select("page_id", "host", F.explode("near").alias("n"))
    return rows.select("page_id", "host", "n.block_ord", F.xxhash64("n.folded").alias("key"), "n.slots", "n.folded")


def _maybe_short(p: Pages) -> DataFrame:
    """The rows of the pages whose body may have at most ``SOLE_WORDS`` words: no block of the main container is longer, or the first that is holds a boilerplate line."""
    none = p.profile.where("long_line is null").select("page_id")
    known = p.profile.select("page_id", F.col("long_line").alias("line")).join(p.lines, "line", "left_semi").select("page_id")
    # written, so that the planner knows their number
    return p.profile.join(keep(none.unionByName(known).dropDuplicates(["page_id"]), "maybe_short"), "page_id", "left_semi")


def sole_bodies(p: Pages, nodes: DataFrame) -> DataFrame:
    """``slots, folded`` of the sentences that are seen in short bodies on several hosts, or in
    notices where there is no body at all, and seldom elsewhere.  Blocks with fields or
    filler are known by themselves and teach nothing."""
    some = _maybe_short(p)
    body = block_marks(Pages(some, p.lines)).where("is_body").groupBy("page_id").agg(F.sum("words").alias("n"), F.collect_set(F.when(~field_flag(), F.col("block_ord"))).alias("own"))
    here = some.select("page_id", "host", "near").join(body, "page_id", "left").where(F.coalesce("n", F.lit(0)) <= SOLE_WORDS)
    own = F.coalesce("own", F.array(F.lit(NOTICE)))
    said = here.withColumn("own", own).select("page_id", "host", F.explode(F.expr("filter(near, n -> array_contains(own, n.block_ord))")).alias("n"))
    alone = said.select("page_id", "host", F.xxhash64("n.folded").alias("key"), "n.slots", "n.folded").groupBy("key").agg(
        F.count_distinct("page_id").alias("alone"), F.count_distinct("host").alias("hosts"), F.first("slots").alias("slots"), F.first("folded").alias("folded")
    )
    alone = keep(alone.where(F.col("hosts") >= SOLE_HOSTS), "alone")
    every = nodes.where(F.col("block_ord") != TITLE_PART).select("page_id", "key").join(alone.select("key"), "key", "left_semi")
    total = every.groupBy("key").agg(F.count_distinct("page_id").alias("pages"))
    return alone.join(total, "key").where(F.col("alone") >= SOLE_SHARE * F.col("pages")).select("slots", "folded")


def labelled_sentences(nodes: DataFrame, learned: DataFrame | None = None) -> DataFrame:
    """``key`` of the nodes in the components of trusted texts, kept; ``nodes``: ``key, slots, folded``, repeats allowed."""
    s = seeds()
    ring = nodes.sparkSession.createDataFrame(list(zip(s.slots, s.folded)), "slots array<int>, folded string")
    if learned is not None:
        ring = keep(ring.unionByName(learned), "trusted")
    ring = ring.select(F.explode("slots").alias("slot"), F.col("folded").alias("f"))
    done = None
    while True:
        # nodes with a label leave first, else a ring would meet its whole family again
        left = nodes if done is None else nodes.join(done, "key", "left_anti")
        meet = left.select("key", "slots", "folded", F.explode("slots").alias("slot")).join(ring, "slot")
        new = keep(meet.where(_similar(F.col("folded"), F.col("f"))).select("key", "slots", "folded").dropDuplicates(["key"]), "ring")
        done = new.select("key") if done is None else done.unionByName(new.select("key"))
        if new.isEmpty():
            return done
        # written, so that the planner knows its size: a small ring is sent to the nodes
        ring = new.select(F.explode("slots").alias("slot"), F.col("folded").alias("f"))


def residue_blocks(p: Pages, nodes: DataFrame) -> DataFrame:
    """``page_id, block_ord`` of the blocks that are or contain residue, and of labelled notices and title parts, kept."""
    labels = labelled_sentences(nodes.select("key", "slots", "folded"), sole_bodies(p, nodes))
    said = nodes.select("page_id", "block_ord", "key").join(labels, "key", "left_semi").select("page_id", "block_ord")
    shown = p.profile.select("page_id", F.explode("marked").alias("block_ord"))
    return keep(shown.unionByName(said).dropDuplicates(["page_id", "block_ord"]), "residue")


def residue_pages(p: Pages, blocks: DataFrame) -> DataFrame:
    """``page_id, shown`` of the pages with nothing else where the body should be; ``shown``: a block says so."""
    # the pages that can be: those with residue in a block or outside any
    odd = p.profile.where("unblocked").select("page_id").unionByName(blocks.select("page_id")).dropDuplicates(["page_id"])
    some = Pages(p.profile.join(odd, "page_id", "left_semi"), p.lines)
    marks = block_marks(some).join(blocks.withColumn("residue", F.lit(True)), ["page_id", "block_ord"], "left")
    bad = F.col("residue").isNotNull()
    main = F.col("flags").bitwiseAND(MAIN) != 0
    per_page = marks.groupBy("page_id").agg(
        F.sum((F.col("is_body") & ~bad).cast("int")).alias("body"), F.max(main & bad).alias("shown")
    )
    noticed = blocks.where(F.col("block_ord") == NOTICE).select("page_id", F.lit(True).alias("noticed"))
    said = p.profile.select("page_id", "unblocked").dropDuplicates(["page_id"])
    any_of = F.coalesce("shown", F.lit(False)) | F.coalesce("noticed", F.lit(False)) | F.col("unblocked")
    return (
        odd.join(per_page, "page_id", "left")
        .join(noticed, "page_id", "left")
        .join(said, "page_id")
        .where((F.coalesce("body", F.lit(0)) == 0) & any_of)
        .select("page_id", F.coalesce("shown", F.lit(False)).alias("shown"))
    )


def message_titles(p: Pages, nodes: DataFrame, blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """``page_id, block_ord`` of the titles with a part that is labelled, or that is found on residue pages
    and hardly any other, among them pages of several hosts that show a message."""
    parts = nodes.where(F.col("block_ord") == TITLE_PART).select("page_id", "host", "key")
    on = keep(parts.join(pages, "page_id").dropDuplicates(["page_id", "key"]), "title_parts")
    hosts = F.count_distinct(F.when(F.col("shown"), F.col("host"))).alias("hosts")
    some = on.groupBy("key").agg(F.count("*").alias("bad"), hosts).where(F.col("hosts") >= TITLE_HOSTS)
    total = parts.join(some, "key", "left_semi").groupBy("key").agg(F.count_distinct("page_id").alias("pages"))
    learned = some.join(total, "key").where(F.col("bad") >= TITLE_SHARE * F.col("pages")).select("key")
    found = on.join(learned, "key", "left_semi").select("page_id").unionByName(blocks.where(F.col("block_ord") == TITLE_PART).select("page_id"))
    # the title is a page's first block
    titled = p.profile.where(F.get("flags", F.lit(0)).bitwiseAND(TITLE) != 0).select("page_id", F.lit(0).alias("block_ord"))
    return titled.join(found.dropDuplicates(["page_id"]), "page_id", "left_semi")


def whole_residue(p: Pages) -> tuple[DataFrame, DataFrame]:
    """(``page_id, block_ord`` of residue blocks, kept; ``page_id`` of residue pages, kept)."""
    nodes = keep(sentences(p.profile), "sentences")
    blocks = residue_blocks(p, nodes)
    pages = keep(residue_pages(p, blocks), "residue_pages")
    own = blocks.where("block_ord >= 0").unionByName(message_titles(p, nodes, blocks, pages)).dropDuplicates(["page_id", "block_ord"])
    return keep(own, "residue_blocks"), pages.select("page_id")


def find_residue(p: Pages) -> DataFrame:
    """``page_id, block_ord``, with ``block_ord`` -1 for whole pages."""
    blocks, pages = whole_residue(p)
    return blocks.unionByName(pages.select("page_id", F.lit(-1).alias("block_ord")))


def cleaned_blocks(blocks: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``blocks``, each key once, without the found blocks and without all blocks of the found pages."""
    found = keep(found, "found")
    whole = found.where("block_ord = -1").select("page_id")
    left = blocks.join(found, ["page_id", "block_ord"], "left_anti").join(whole, "page_id", "left_anti")
    return left.dropDuplicates(["page_id", "block_ord"])


def cleaned_pages(pages: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``pages``, each ``page_id`` once, without the pages found as a whole; their html is as it was."""
    whole = keep(found.where("block_ord = -1").select("page_id"), "found")
    return pages.join(whole, "page_id", "left_anti").dropDuplicates(["page_id"])
