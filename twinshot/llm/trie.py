"""The trie of conversation prefixes, with subtree totals by parallel tree contraction.

A node is a distinct sequence of first turns. Its name is 120 bits: the exclusive or of a digest of every
turn of the sequence with its place. Running names come from windows over at most ``SLICE`` turns and a
carry from slice to slice, so one conversation of any length is spread over tasks.

Totals over subtrees are taken by contraction, in rounds of joins. Rake: nodes without children are
final, add their totals to the parent and leave. Compress: of a chain of nodes with one child each, those
that a coin picks, and whose child it doesn't pick, are spliced out; the child goes to the grandparent
and carries along what the spliced node adds to it. A round takes all leaves and a share of every chain,
so the number of rounds follows the logarithm of the number of nodes and not the depth. Afterwards the
spliced nodes come back in reverse order: a node's total is its own value and its child's total.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinshot.llm.store import spread_lookup, stored

SLICE = 4096
#: Characters of a piece of a joined list of ids.
PIECE = 1 << 16


def numbered(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, at, role, text): the turns of every conversation, numbered from 1.

    They are ordered by turn, null first, then role and text; null role or text is empty, and repeated
    rows are turns of their own. Rows without conv_id are left out. Rows are dealt out by ranges of
    (conversation, order), so a conversation longer than a partition has a part in several; places
    are counted in the parts and shifted by the sizes of the parts before.
    """
    rows = turns.select(
        F.col(conv_id).cast("long").alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    ).where("conv_id is not null")
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    ranged = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange("conv_id", *order, "_tie")
    parts = stored(ranged.withColumn("_part", F.spark_partition_id()))
    here = Window.partitionBy("conv_id", "_part").orderBy(*order, "_tie")
    before = Window.partitionBy("conv_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = (
        parts.groupBy("conv_id", "_part")
        .agg(F.count("*").alias("_n"))
        .select("conv_id", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    )
    placed = parts.withColumn("_at", F.row_number().over(here)).join(shift, ["conv_id", "_part"])
    return placed.select("conv_id", (F.col("_at") + F.col("_shift")).cast("long").alias("at"), "role", "text")


def grafted(turns: DataFrame, convs: DataFrame, base: Column, head: Column, longest: int) -> DataFrame:
    """Conversations rebuilt from another one's beginning and their own end: (conv_id, at, role, text).

    ``turns`` is a ``numbered`` table, ``convs`` the conversations (conv_id). Conversation c becomes the
    first ``head`` turns of conversation ``base`` (all if it has fewer, none if there is none) and its own
    turns after the first ``head``. Both are expressions over conv_id, and no head is over ``longest``.
    """
    plan = convs.select("conv_id", base.alias("_base"), head.cast("long").alias("_head"))
    first = turns.where(F.col("at") <= longest).select(F.col("conv_id").alias("_base"), "at", "role", "text")
    begin = plan.join(first, "_base").where("at <= _head").select("conv_id", "at", "role", "text")
    size = begin.groupBy("conv_id").agg(F.count("*").alias("_size"))
    sized = plan.join(size, "conv_id", "left").select("conv_id", "_head", F.coalesce("_size", F.lit(0)).alias("_size"))
    end = spread_lookup(turns, sized, ["conv_id"], F.col("at")).where("at > _head")
    return begin.union(end.select("conv_id", (F.col("at") - F.col("_head") + F.col("_size")).alias("at"), "role", "text"))


def _digest(*parts: Column) -> tuple[Column, Column]:
    """Two numbers of 60 bits from a digest of the parts, each preceded by its length."""
    marked = [F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in (q.cast("string") for q in parts)]
    digest = F.sha2(F.concat(*marked), 256)
    return tuple(F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("long") for i in (0, 1))


def named_prefixes(paths: DataFrame) -> DataFrame:
    """(conv_id, depth, k1, k2, p1, p2, chars): every prefix of every path with its name and its parent's."""
    h1, h2 = _digest(F.col("at"), F.col("role"), F.col("text"))
    rows = paths.select(
        "conv_id", "at", ((F.col("at") - 1) / SLICE).cast("long").alias("_slice"), h1.alias("h1"), h2.alias("h2"), F.length("text").cast("long").alias("chars")
    )
    here = Window.partitionBy("conv_id", "_slice").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy("conv_id", "_slice").agg(F.bit_xor("h1").alias("c1"), F.bit_xor("h2").alias("c2"))
    carried = carried.select(
        "conv_id", "_slice", *[F.coalesce(F.bit_xor(c).over(before), F.lit(0).cast("long")).alias(c) for c in ("c1", "c2")]
    )
    running = rows.withColumns({"r1": F.bit_xor("h1").over(here), "r2": F.bit_xor("h2").over(here)}).join(carried, ["conv_id", "_slice"])
    name = {f"k{i}": F.col(f"r{i}").bitwiseXOR(F.col(f"c{i}")) for i in (1, 2)}
    return running.withColumns(name).select(
        "conv_id",
        F.col("at").alias("depth"),
        "k1",
        "k2",
        F.col("k1").bitwiseXOR(F.col("h1")).alias("p1"),
        F.col("k2").bitwiseXOR(F.col("h2")).alias("p2"),
        "chars",
    )


def prefix_trie(paths: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the trie, with how often each is met and the totals of its subtree.

    ``paths`` holds (conv_id, at, role, text) with places 1, 2, ... of every conversation, ``convs`` all
    conversations (conv_id), turnless ones included. Returns ``conv_id`` (smallest member), ``depth``,
    ``parent_conv_id`` (the parent's smallest member; null at the root), ``n_convs``, ``n_children``,
    ``n_leaves`` (childless nodes of the subtree), ``saved`` (over the subtree, (n_convs - 1) times the
    code points of a node's last text) and ``ends_sha256`` (digest of the ids of the conversations that end
    there, ascending, joined by commas). A node's text is turn ``depth`` of conversation ``conv_id``.
    Without conversations there are no nodes, not even a root. Nodes are told apart by 120 bits.
    """
    convs = stored(convs.select(F.col("conv_id").cast("long").alias("conv_id")).where("conv_id is not null").distinct())
    prefixes = stored(named_prefixes(paths))
    key = ["depth", "k1", "k2"]
    zero = F.lit(0).cast("long")
    found = prefixes.groupBy(*key).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("chars").alias("chars")
    )
    none = F.lit(None).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), "conv_id", "n_convs", none.alias("p1"), none.alias("p2"), zero.alias("chars"))
    nodes = stored(found.union(root.select(*found.columns)))

    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    below = spread_lookup(nodes.where("depth > 0"), parents, ["depth", "p1", "p2"], F.col("conv_id"))
    linked = below.unionByName(nodes.where("depth = 0").withColumn("parent_conv_id", none))
    linked = stored(
        linked.join(children, key, "left").withColumns(
            {"n_children": F.coalesce("n_children", F.lit(0)).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("chars")}
        )
    )
    tree = linked.select(
        "conv_id",
        "depth",
        F.col("parent_conv_id").alias("up_conv"),
        (F.col("depth") - 1).alias("up_depth"),
        F.col("n_children").alias("kids"),
        (F.col("n_children") == 0).cast("long").alias("n_leaves"),
        "saved",
    )
    totals = subtree_totals(tree, ["conv_id", "depth"], ["up_conv", "up_depth"], ["n_leaves", "saved"])

    last = prefixes.groupBy("conv_id").agg(F.max_by(F.struct(*key), "depth").alias("end"))
    last = last.select("conv_id", "end.*")
    turnless = convs.join(prefixes.select("conv_id").distinct(), "conv_id", "left_anti").select("conv_id", *[zero.alias(c) for c in key])
    ends = joined_ids(last.union(turnless), key, "conv_id")
    out = linked.drop("saved").join(totals, ["conv_id", "depth"]).join(ends, key, "left")
    return out.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        "saved",
        F.coalesce("sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def subtree_totals(tree: DataFrame, node: list[str], parent: list[str], values: list[str]) -> DataFrame:
    """(node..., values...): every column of values summed over each node's subtree, the node included.

    ``tree`` has one row per node: its id, its parent's id (null at a root; several roots are a forest),
    ``kids`` (number of children) and the values. Rounds and memory don't depend on the depth or on the
    number of children of a node. An empty table gives an empty one.
    """
    total = [f"_t_{v}" for v in values]  # gathered so far from the node itself and its finished children
    carry = [f"_c_{v}" for v in values]  # what goes to the parent besides the node's total
    zero = F.lit(0).cast("long")
    active = tree.select(
        *node, *parent, "kids", *[F.col(v).cast("long").alias(t) for v, t in zip(values, total)], *[zero.alias(c) for c in carry]
    )
    up = dict(zip(parent, node))
    final: list[DataFrame] = []
    spliced: list[DataFrame] = []
    rounds = 0
    while True:
        leaf = F.col("kids") == 0
        final.append(active.where(leaf).select(*node, *[F.col(t).alias(v) for v, t in zip(values, total)]))
        gained = (
            active.where(F.col(parent[0]).isNotNull())
            .groupBy(*[F.col(p).alias(n) for p, n in up.items()])
            .agg(
                *[F.sum(F.when(leaf, F.col(t) + F.col(c)).otherwise(zero)).alias(f"_g{t}") for t, c in zip(total, carry)],
                F.count_if(~leaf).alias("_left"),
                F.min(F.when(~leaf, F.struct(*node))).alias("_child"),
            )
        )
        picked = (F.col("_left") == 1) & F.col(parent[0]).isNotNull() & (F.xxhash64(*node, F.lit(rounds)).bitwiseAND(1) == 1)
        raked = stored(
            active.where(~leaf)
            .join(gained, node)
            .select(*node, *parent, F.col("_left").alias("kids"), *[(F.col(t) + F.col(f"_g{t}")).alias(t) for t in total], *carry, "_child", picked.alias("_picked"))
        )
        if not raked.limit(1).count():
            break
        # A picked node leaves if its only child stays.
        child = raked.where("not _picked").select(F.struct(*node).alias("_child"), *[F.col(c).alias(f"_below{c}") for c in carry])
        gone = stored(raked.where("_picked").join(child, "_child"))
        spliced.append(
            gone.select(*node, "_child", *[(F.col(t) + F.col(f"_below{c}")).alias(t) for t, c in zip(total, carry)])
        )
        moved = gone.select(
            *[F.col(f"_child.{n}").alias(n) for n in node],
            *[F.col(p).alias(f"_new_{p}") for p in parent],
            *[(F.col(t) + F.col(c)).alias(f"_more{c}") for t, c in zip(total, carry)],
        )
        stay = raked.join(gone.select(*node), node, "left_anti").join(moved, node, "left")
        active = stored(
            stay.select(
                *node,
                *[F.when(F.col(f"_new_{parent[0]}").isNotNull(), F.col(f"_new_{p}")).otherwise(F.col(p)).alias(p) for p in parent],
                "kids",
                *total,
                *[(F.col(c) + F.coalesce(f"_more{c}", zero)).alias(c) for c in carry],
            )
        )
        rounds += 1

    # Back again: the child of a node spliced in round r became final, or was spliced, later than that.
    # ``known`` is what left after the round at hand, so every look-up reads only the tree of its time.
    known = final[rounds]
    done = [final[0]] if rounds else []
    for r in reversed(range(rounds)):
        later = known.select(F.struct(*node).alias("_child"), *values)
        again = stored(
            spliced[r].join(later, "_child").select(*node, *[(F.col(t) + F.col(v)).alias(v) for t, v in zip(total, values)])
        )
        known = known.union(again).union(final[r]) if r else known.union(again)
    for part in done:
        known = known.union(part)
    return known


def joined_ids(rows: DataFrame, key: list[str], id: str) -> DataFrame:
    """(key..., sha256): digest of each key's ids, ascending, joined by commas.

    A digest of one text can't be computed in parts, but the text can be: ids are dealt out by ranges of
    (key, id), each range joins its ids to pieces of ``PIECE`` characters, and the pieces pass through the
    hash in order. So even a key with most of the ids is one row per piece in the end.
    """
    names = [f"k{i}" for i in range(len(key))]
    plain = rows.select(*[F.col(k).cast("long").alias(n) for k, n in zip(key, names)], F.col(id).cast("long").alias("id"))
    ranged = plain.repartitionByRange(*names, "id").sortWithinPartitions(*names, "id").withColumn("part", F.spark_partition_id())

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, now, held, size = 0, None, [], 0
        for batch in batches:
            out = []
            columns = [batch.column(n).to_pylist() for n in [*names, "id", "part"]]
            for *k, i, part in zip(*columns):
                if (k != now and held) or size >= PIECE:
                    out.append((*now, where, seq, ",".join(held)))
                    seq, held, size = seq + 1, [], 0
                now, where = k, part
                held.append(str(i))
                size += len(held[-1]) + 1
            yield _rows(out, piece)
        if held:
            yield _rows([(*now, where, seq, ",".join(held))], piece)

    piece = pa.schema([*[(n, pa.int64()) for n in names], ("part", pa.int32()), ("seq", pa.int64()), ("body", pa.string())])
    ddl = ", ".join(f"{n} long" for n in names)
    cut = ranged.mapInArrow(pieces, f"{ddl}, part int, seq long, body string")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            out = []
            for *k, body in zip(*[batch.column(n).to_pylist() for n in [*names, "body"]]):
                if k != now:
                    if now is not None:
                        out.append((*now, state.hexdigest()))
                    now, state = k, hashlib.sha256(body.encode())
                else:
                    state.update(b"," + body.encode())
            yield _rows(out, digest)
        if now is not None:
            yield _rows([(*now, state.hexdigest())], digest)

    digest = pa.schema([*[(n, pa.int64()) for n in names], ("sha256", pa.string())])
    sums = cut.repartition(*names).sortWithinPartitions(*names, "part", "seq").mapInArrow(hashed, f"{ddl}, sha256 string")
    return sums.select(*[F.col(n).alias(k) for n, k in zip(names, key)], "sha256")


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
