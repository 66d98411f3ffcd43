"""Rebuilding conversations from message rows, by an overlap graph of message fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm._cut import cut
from skein.llm._spread import hot_keys, in_every_block, in_own_block

#: Messages of a fragment besides the one that it shares with the next.
WINDOW = 16
#: Every spelling of a role in use by the clients, in lower case and without surrounding spaces.
ROLE_NAMES = {
    "user": ("user", "human"),
    "assistant": ("assistant", "ai", "bot"),
    "kb": ("kb",),
}


def canonical_role(role: Column, names: dict[str, tuple[str, ...]] = ROLE_NAMES) -> Column:
    """user, assistant, kb or null (null, empty and any other spelling)."""
    plain = F.lower(F.trim(role))
    found = F.lit(None).cast("string")
    for name, spellings in names.items():
        found = F.when(plain.isin(*spellings), F.lit(name)).otherwise(found)
    return found


def turns(memory: DataFrame, meta: DataFrame) -> DataFrame:
    """(sessionId, number, rowid, role, content): the valid turn of each row, not checked.

    Of several rows with one memId that with the smallest rowid is valid; rows
    without memId stand for themselves. Of several meta rows of a rowid the
    least is taken. Knowledge-base rows are dropped, as are rows without a
    session in either table. `number` is turnIndex, else the digits that end
    memId, else null.
    """
    m = memory.where(F.col("rowid").isNotNull()).select("rowid", "memId", "role", "content", F.col("sessionId").alias("_session"))
    key = F.coalesce(F.concat(F.lit("m"), F.col("memId")), F.concat(F.lit("r"), F.col("rowid").cast("string")))
    valid = m.groupBy(key.alias("_key")).agg(F.min_by(F.struct("memId", "role", "content", "_session"), "rowid").alias("_v"), F.min("rowid").alias("rowid")).select("rowid", "_v.*")
    valid = valid.withColumn("role", canonical_role(F.col("role")))
    valid = valid.where(F.col("role").isNull() | (F.col("role") != "kb"))
    facts = meta.groupBy("rowid").agg(F.min(F.struct("turnIndex", "sessionId")).alias("_f")).select("rowid", F.col("_f.turnIndex").alias("_turn"), F.col("_f.sessionId").alias("_other"))
    from_id = F.expr(r"try_cast(nullif(regexp_extract(memId, '([0-9]+)$', 1), '') as bigint)")
    return (
        valid.join(facts, "rowid", "left")
        .select(F.trim(F.coalesce("_session", "_other")).alias("sessionId"), F.coalesce(F.col("_turn"), from_id).alias("number"), "rowid", "role", "content")
        .where(F.col("sessionId").isNotNull())
    )


def overlaps(fragments: DataFrame, least: int = 1, most: int | None = None) -> DataFrame:
    """(left, right, shared): the longest suffix of `left` that equals a prefix of `right`, in messages.

    fragments(fragment, messages): ids and ordered message hashes. Suffixes and
    prefixes of `least` to `most` messages (None: of all lengths below the
    fragment's own) are joined by their hash and compared message by message.
    """
    n = F.size("messages")
    bound = n - 1 if most is None else F.least(n - 1, F.lit(most))
    lengths = F.when(bound >= least, F.sequence(F.lit(least), bound)).otherwise(F.array().cast("array<int>"))
    of = lambda end: fragments.select("fragment", F.explode(lengths).alias("shared"), "messages").select("fragment", "shared", F.slice("messages", F.lit(1) if end == "prefix" else n - F.col("shared") + 1, F.col("shared")).alias("part"))
    suffix = of("suffix").select(F.col("fragment").alias("left"), "shared", F.xxhash64("part").alias("h"), "part")
    prefix = of("prefix").select(F.col("fragment").alias("right"), "shared", F.xxhash64("part").alias("h"), F.col("part").alias("other"))
    same = suffix.join(prefix, ["h", "shared"]).where((F.col("part") == F.col("other")) & (F.col("left") != F.col("right")))
    return same.groupBy("left", "right").agg(F.max("shared").alias("shared"))


def without_implied(fragments: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges a -> c for which no fragment b stands between, with edges a -> b -> c that put c at the same place."""
    steps = edges.join(fragments.select(F.col("fragment").alias("left"), F.col("n")), "left").select("left", "right", (F.col("n") - F.col("shared")).alias("step"))
    first, second = steps.select(F.col("left"), F.col("right").alias("by"), F.col("step").alias("x")), steps.select(F.col("left").alias("by"), "right", F.col("step").alias("y"))
    implied = first.join(second, "by").select("left", "right", (F.col("x") + F.col("y")).alias("step")).join(steps, ["left", "right", "step"], "left_semi")
    return edges.join(implied.select("left", "right").distinct(), ["left", "right"], "left_anti")


def without_contained(fragments: DataFrame) -> DataFrame:
    """The fragments that are no stretch of another one; of equal ones that with the least id stays."""
    places = fragments.select(F.col("fragment").alias("other"), F.col("messages").alias("whole"), F.posexplode("messages").alias("at", "first"))
    inside = (
        fragments.withColumn("first", F.col("messages")[0])
        .join(places, "first")
        .where((F.col("fragment") != F.col("other")) & (F.slice("whole", F.col("at") + 1, F.size("messages")) == F.col("messages")))
        .where((F.size("whole") > F.size("messages")) | (F.col("other") < F.col("fragment")))
    )
    return fragments.join(inside.select("fragment").distinct(), "fragment", "left_anti")


def merge_paths(fragments: DataFrame, edges: DataFrame) -> DataFrame:
    """(fragment, path, offset, whole): each fragment's path in the overlap graph and its first message's place in it.

    fragments(fragment, n) and edges(left, right, shared). An edge counts only
    where it is the one edge out of its left and the one into its right
    fragment; others are ambiguous. A path is named by its first fragment.
    Fragments of cycles are left out. `whole` is false where an ambiguous edge
    touches the fragment.

    Pointer jumping: each round doubles the stretch that a fragment looks back,
    so that a path of n fragments takes log2 n joins by fragment id, a key
    without repetitions; what has reached its head takes no further part.
    """
    out, into = edges.groupBy("left").agg(F.count(F.lit(1)).alias("o")), edges.groupBy("right").agg(F.count(F.lit(1)).alias("i"))
    counted = edges.join(out, "left").join(into, "right")
    clear = (F.col("o") == 1) & (F.col("i") == 1)
    unclear = counted.where(~clear).select(F.explode(F.array("left", "right")).alias("fragment")).distinct().withColumn("unclear", F.lit(True))
    back = counted.where(clear).select(F.col("right").alias("fragment"), F.col("left").alias("to"), "shared")
    sized = fragments.select(F.col("fragment").alias("to"), F.col("n").alias("before"))
    steps = back.join(sized, "to").select("fragment", "to", (F.col("before") - F.col("shared")).cast("long").alias("offset"))
    state = cut(fragments.select("fragment").join(steps, "fragment", "left").select("fragment", F.coalesce("to", "fragment").alias("to"), F.coalesce("offset", F.lit(0)).cast("long").alias("offset"), F.col("to").isNull().alias("done")))
    open_, heads = state.where(~F.col("done")), state.where("done")
    left = open_.count()
    limit = left.bit_length() + 1
    for _ in range(limit):
        if not left:
            break
        known = open_.unionByName(heads).select(F.col("fragment").alias("to"), F.col("to").alias("further"), F.col("offset").alias("more"), F.col("done").alias("end"))
        new = cut(open_.join(known, "to").select("fragment", F.col("further").alias("to"), (F.col("offset") + F.col("more")).alias("offset"), F.col("end").alias("done")))
        heads, open_ = heads.unionByName(new.where("done")), new.where(~F.col("done"))
        left = open_.count()
    placed = heads.select("fragment", F.col("to").alias("path"), "offset")
    return placed.join(unclear, "fragment", "left").select("fragment", "path", "offset", F.col("unclear").isNull().alias("whole"))


def assemble(fragments: DataFrame, least: int = 1, most: int | None = None) -> DataFrame:
    """(message, path, position): the messages of overlapping export fragments in order, once each.

    fragments(fragment, messages): unique ids and arrays of message hashes, in
    the order of the export. Contained and repeated fragments are dropped, the
    others joined where `least` or more messages at the end of one are those at
    the start of another; links that follow from others are left out. Paths
    with an ambiguous junction are dropped.
    """
    kept = without_contained(fragments.where(F.size("messages") > 0))
    sized = kept.select("fragment", F.size("messages").alias("n"))
    placed = merge_paths(sized, cut(without_implied(sized, overlaps(kept, least, most))))
    bad = placed.where(~F.col("whole")).select("path").distinct()
    good = placed.join(bad, "path", "left_anti").join(kept, "fragment")
    each = good.select("path", F.posexplode("messages").alias("at", "message"), "offset")
    return each.select("message", "path", (F.col("offset") + F.col("at")).alias("position")).distinct()


def export_fragments(rows: DataFrame) -> DataFrame:
    """(sessionId, fragment, first, messages): overlapping stretches of a chat, as arrays of message hashes.

    rows(sessionId, number, message), no two of one number in a session. A
    stretch holds the messages of WINDOW consecutive numbers and the next
    window's first message, which both windows share; where a number lacks, the
    stretch ends. Windows are bounded and keyed by session and number, so that
    a chat of any length is spread over tasks. An id is the hash of a
    fragment's first message and its length.
    """
    at = F.pmod("number", F.lit(WINDOW))
    window = F.floor(F.col("number") / WINDOW)
    twice = F.when(at == 0, F.array(window - 1, window)).otherwise(F.array(window))
    windows = rows.select("sessionId", F.explode(twice).alias("w"), "number", "message").groupBy("sessionId", "w").agg(F.array_sort(F.collect_list(F.struct("number", "message"))).alias("m"))
    breaks = F.filter(F.sequence(F.lit(0), F.size("m") - 1), lambda i: (i == 0) | (F.col("m")[i]["number"] != F.col("m")[F.greatest(i - 1, F.lit(0))]["number"] + 1))
    stretches = windows.withColumn("breaks", breaks).select("sessionId", "w", "m", F.posexplode("breaks").alias("k", "start"), "breaks")
    end = F.coalesce(F.get("breaks", F.col("k") + 1), F.size("m"))
    cut_out = stretches.select("sessionId", "w", F.slice("m", F.col("start") + 1, end - F.col("start")).alias("m"))
    # a shared message alone says nothing that the window it begins doesn't say
    own = cut_out.where((F.size("m") > 1) | (F.floor(F.col("m")[0]["number"] / WINDOW) == F.col("w")))
    return own.select("sessionId", F.xxhash64(F.col("m")[0]["message"], F.size("m")).alias("fragment"), F.col("m")[0]["number"].alias("first"), F.col("m.message").alias("messages"))


def rebuild(memory: DataFrame, meta: DataFrame, first_numbers: tuple[int, ...] = (0, 1)) -> DataFrame:
    """(sessionId, position, rowid, role, content): the ordered turns of each whole conversation.

    The hash of a message is that of its session, number, role and content.
    Chats are cut into export fragments that overlap by a message
    (`export_fragments`); a fragment whose last message is another one's first
    is linked to it, unambiguous links are merged to paths (`merge_paths`), and
    a turn's `position` is its place along the path, from 0. A chat is kept
    when it is one path that holds all its messages (a missing number leaves
    two paths, a number met twice makes the place ambiguous), its first number
    is one of `first_numbers`, every role is known, roles alternate from the
    user's to the assistant's and each content has a letter or digit.

    Chats with a number met twice or none at all are found by one aggregation
    keyed by session and number. Chats are judged by partial aggregates and
    joined in blocks (`_spread`), so that one that holds most of the rows is
    never gathered in one task. Empty
    tables give an empty result; rows without number or session break nothing
    but their own session (a null number drops it). Further columns are
    ignored.
    """
    sound = F.col("role").isNotNull() & F.coalesce(F.col("content").rlike(r"[\p{L}\p{N}]"), F.lit(False))
    rows = cut(turns(memory, meta).select("sessionId", "number", "rowid", "role", "content", sound.alias("sound"), F.xxhash64("sessionId", "number", "role", "content").alias("message")))
    numbers = rows.groupBy("sessionId", "number").agg(F.count(F.lit(1)).alias("n"), F.min("sound").alias("sound"))
    sessions = cut(numbers.groupBy("sessionId").agg(F.sum("n").alias("rows"), F.max("n").alias("most"), F.min("sound").alias("sound"), F.max(F.col("number").isNull()).alias("lost"), F.count(F.lit(1)).alias("turns")))
    hot = hot_keys(sessions, "sessionId", "rows")
    fit = sessions.where("most = 1 and sound and not lost and turns % 2 = 0").select("sessionId", "turns")
    of = lambda df, chosen: in_own_block(df, "sessionId", hot, "message").join(in_every_block(chosen.select("sessionId"), "sessionId", hot), ["sessionId", "_block"], "left_semi").drop("_block")
    chats = of(rows.select("sessionId", "number", "message"), fit)
    fragments = cut(export_fragments(chats))
    ends = fragments.select("fragment", F.size("messages").alias("n"), F.col("messages")[0].alias("first"), F.element_at("messages", -1).alias("last"))
    left, right = ends.select(F.col("fragment").alias("left"), F.col("last").alias("h")), ends.where("n > 0").select(F.col("fragment").alias("right"), F.col("first").alias("h"))
    edges = left.join(right, "h").where("left != right").select("left", "right", F.lit(1).alias("shared"))
    paths = merge_paths(ends.select("fragment", "n"), edges)
    placed = fragments.join(paths, "fragment")
    each = placed.select("sessionId", "path", "first", "offset", "whole", F.posexplode("messages").alias("at", "message")).select("sessionId", "message", "path", (F.col("offset") + F.col("at")).alias("position"), "whole", F.when((F.col("offset") == 0) & (F.col("at") == 0), F.col("first")).alias("first"))
    each = each.groupBy("sessionId", "message").agg(F.min("path").alias("path"), F.max("path").alias("path_too"), F.min("position").alias("position"), F.max("position").alias("position_too"), F.min("whole").alias("whole"), F.max("first").alias("first"))
    speakers = each.join(rows.select("sessionId", "message", "rowid", "role", "content"), ["sessionId", "message"])
    turn = speakers.withColumn("in_turn", (F.pmod("position", F.lit(2)) == 0) == (F.col("role") == "user"))
    judged = turn.groupBy("sessionId").agg(
        F.min("path").alias("path"), F.max("path_too").alias("path_too"), F.min("whole").alias("whole"), F.min(F.col("position") == F.col("position_too")).alias("one_place"),
        F.max("position").alias("last"), F.max("first").alias("first"), F.min("in_turn").alias("in_turn"),
    )
    kept = judged.join(fit, "sessionId").where(F.col("whole") & F.col("one_place") & F.col("in_turn") & (F.col("path") == F.col("path_too")) & (F.col("last") + 1 == F.col("turns")) & F.col("first").isin(*first_numbers))
    return of(turn, kept).select("sessionId", F.col("position").cast("long").alias("position"), "rowid", "role", "content")
