"""Conversations in budgeted windows of formatted text, in DataFrame functions only.

A turn is written ``### role: text</turn>`` and a line end. In texts the characters that
markers are made of are replaced by a backslash and a letter, which is undone on reading, so
that no text can pass for a marker. Prefix sums of the turns' tokens decide where windows
start; each window holds whole turns, opens with the system turn and some turns before it,
and its loss mask covers assistant texts that no earlier window has had as targets.

A conversation may be of any length. Turns are numbered and summed over ranges of rows, windows
are chosen in stretches of ``STRETCH`` turns, and only what one window holds is put together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from groundwell.llm.common import n_words, ready, saved

#: Tokens of a window, and of repeated turns in it; turns that are repeated at most.
BUDGET = 1024
HISTORY = 128
HISTORY_TURNS = 4
#: Turns after which a new window starts in any case.
STRETCH = 512
#: The template.
TURN, COLON, END = "### ", ": ", "</turn>\n"
_ESCAPES = (("\\", "\\s"), ("<", "\\l"), ("#", "\\h"))
_ROLE_ESCAPES = (*_ESCAPES, (":", "\\c"), ("\n", "\\n"))


def _replaced(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def escaped(text: Column, role: bool = False) -> Column:
    return _replaced(text, list(_ROLE_ESCAPES if role else _ESCAPES))


def unescaped(text: Column, role: bool = False) -> Column:
    pairs = _ROLE_ESCAPES if role else _ESCAPES
    return _replaced(text, [(new, old) for old, new in reversed(pairs)])


def numbered(turns: DataFrame) -> DataFrame:
    """``conv_id, no, before, tokens, role, text``: turns by number, with the tokens before.

    Rows go by turn (null first), then role and text. A long conversation is ranged over many
    tasks; what meets per conversation is one row for each of them.
    """
    ranged = saved(
        turns.select(
            "conv_id",
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
            "turn",
        )
        .withColumn("tokens", n_words("text"))
        .repartitionByRange("conv_id", "turn")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .withColumn("part", F.spark_partition_id())
        .withColumn("at", F.monotonically_increasing_id())
    )
    sums = ranged.groupBy("conv_id", "part").agg(
        F.count("*").alias("rows"), F.sum("tokens").alias("sum")
    )
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    zero = F.lit(0).cast("long")
    offsets = sums.select(
        F.col("conv_id").alias("c"),
        F.col("part").alias("p"),
        F.coalesce(F.sum("rows").over(earlier), zero).alias("rows_before"),
        F.coalesce(F.sum("sum").over(earlier), zero).alias("tokens_before"),
    )
    inside = Window.partitionBy("conv_id", "part").orderBy("at")
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        ranged.withColumn("row", F.row_number().over(inside))
        .withColumn("sum", F.sum("tokens").over(so_far))
        .join(offsets, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")))
        .select(
            "conv_id",
            (F.col("rows_before") + F.col("row") - 1).alias("no"),
            (F.col("tokens_before") + F.col("sum") - F.col("tokens")).alias("before"),
            "tokens",
            "role",
            "text",
        )
    )


def _window_starts(tokens: Column, room: Column) -> Column:
    """Offsets of the turns that start a window, first fit in order."""
    state = F.struct(
        F.lit(0).cast("long").alias("used"),
        F.lit(0).alias("no"),
        F.array().cast("array<int>").alias("starts"),
    )

    def step(now: Column, size: Column) -> Column:
        new = (now["no"] == 0) | (now["used"] + size > room)
        return F.struct(
            F.when(new, size).otherwise(now["used"] + size).alias("used"),
            (now["no"] + 1).alias("no"),
            F.when(new, F.concat(now["starts"], F.array(now["no"])))
            .otherwise(now["starts"])
            .alias("starts"),
        )

    return F.aggregate(tokens, state, step, lambda now: now["starts"])


def windows(
    turns: DataFrame, budget: int = BUDGET, history: int = HISTORY
) -> DataFrame:
    """One row per window: ``conv_id, first_turn, n_turns, n_repeated, tokens, formatted, loss``.

    ``turns`` has ``conv_id, turn, role, text``. ``formatted`` holds ``n_repeated`` repeated
    turns (the system turn, then turns of the history) and ``n_turns`` new ones, of which
    ``first_turn`` is the first by number; ``loss`` lists ``start, size`` of the assistant
    texts among the new turns, in characters. Every turn is new in exactly one window. A
    window goes over ``budget`` tokens only where one turn with the system turn does. The
    system turn is a first turn of role ``system``.

    Null roles and texts count as empty, null conversation ids as one conversation; repeated
    rows are turns of their own; other columns are not read; an empty table has no windows.
    """
    ready(turns.sparkSession)
    own = saved(numbered(turns))
    stretch = F.floor(F.col("no") / STRETCH)
    system = (
        own.where("no = 0 and role = 'system'")
        .select(
            F.col("conv_id").alias("sys_conv"),
            F.lit(0).cast("long").alias("sys_no"),
            F.col("tokens").alias("sys_tokens"),
            F.col("text").alias("sys_text"),
        )
    )
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    room = F.greatest(
        F.lit(budget - history) - F.coalesce("sys_tokens", F.lit(0).cast("long")), F.lit(1)
    )
    starts = (
        own.groupBy("conv_id", stretch.alias("stretch"))
        .agg(F.sort_array(F.collect_list(F.struct("no", "before", "tokens"))).alias("turns"))
        .join(system, same("conv_id", "sys_conv"), "left")
        .withColumn("starts", _window_starts(F.col("turns.tokens"), room))
    )
    chosen = saved(
        starts.select("conv_id", "sys_text", "turns", "starts", F.posexplode("starts").alias("i", "at"))
        .withColumn("next", F.coalesce(F.get("starts", F.col("i") + 1), F.size("turns")))
        .select(
            "conv_id",
            "sys_text",
            F.col("turns")[F.col("at")]["no"].alias("first_turn"),
            F.col("turns")[F.col("at")]["before"].alias("first_before"),
            (F.col("next") - F.col("at")).cast("long").alias("n_turns"),
        )
    )
    # New turns find their window by number; candidates for the history are a few per window.
    new = chosen.select(
        "conv_id",
        F.col("first_turn").alias("window"),
        F.explode(F.sequence("first_turn", F.col("first_turn") + F.col("n_turns") - 1)).alias("no"),
        F.lit(2).alias("kind"),
        F.lit(None).cast("long").alias("from"),
    )
    has_system = F.col("sys_text").isNotNull().cast("long")
    back = (
        chosen.withColumn(
            "low", F.greatest(F.col("first_turn") - HISTORY_TURNS, has_system)
        )
        .where("low < first_turn")
        .select(
            "conv_id",
            F.col("first_turn").alias("window"),
            F.explode(F.sequence("low", F.col("first_turn") - 1)).alias("no"),
            F.lit(1).alias("kind"),
            (F.col("first_before") - history).alias("from"),
        )
    )
    wanted = new.unionByName(back).select(
        F.col("conv_id").alias("c"), "window", F.col("no").alias("n"), "kind", "from"
    )
    entry = lambda kind, no, role, text, tokens: F.struct(
        kind.alias("kind"), no.alias("no"), role.alias("role"), text.alias("text"), tokens.alias("tokens")
    )
    members = (
        own.join(wanted, same("conv_id", "c") & (F.col("no") == F.col("n")))
        .where("from is null or before >= from")
        .select(
            "conv_id",
            "window",
            entry(F.col("kind"), F.col("no"), F.col("role"), F.col("text"), F.col("tokens")).alias("e"),
        )
    )
    repeated_system = (
        chosen.where("first_turn > 0 and sys_text is not null")
        .select(
            "conv_id",
            F.col("first_turn").alias("window"),
            entry(
                F.lit(0), F.lit(0).cast("long"), F.lit("system"), F.col("sys_text"), n_words("sys_text")
            ).alias("e"),
        )
    )
    put = (
        members.unionByName(repeated_system)
        .groupBy("conv_id", "window")
        .agg(F.sort_array(F.collect_list("e")).alias("turns"))
    )
    head = F.transform(
        "turns",
        lambda e: F.concat(F.lit(TURN), escaped(e["role"], role=True), F.lit(COLON)),
    )
    state = F.struct(
        F.lit(0).cast("long").alias("at"),
        F.array().cast("array<struct<start:bigint,size:bigint>>").alias("loss"),
    )

    def step(now: Column, piece: Column) -> Column:
        start = now["at"] + F.length(piece["head"])
        size = F.length(piece["body"]).cast("long")
        span = F.array(F.struct(start.alias("start"), size.alias("size")))
        return F.struct(
            (start + size + len(END)).alias("at"),
            F.when(piece["target"], F.concat(now["loss"], span)).otherwise(now["loss"]).alias("loss"),
        )

    return (
        put.withColumn(
            "pieces",
            F.transform(
                F.arrays_zip(F.col("turns"), head.alias("head")),
                lambda z: F.struct(
                    z["head"].alias("head"),
                    escaped(z["turns"]["text"]).alias("body"),
                    ((z["turns"]["kind"] == 2) & (z["turns"]["role"] == "assistant")).alias("target"),
                ),
            ),
        )
        .select(
            "conv_id",
            F.col("window").alias("first_turn"),
            F.size(F.filter("turns", lambda e: e["kind"] == 2)).cast("long").alias("n_turns"),
            F.size(F.filter("turns", lambda e: e["kind"] < 2)).cast("long").alias("n_repeated"),
            F.aggregate(
                "turns", F.lit(0).cast("long"), lambda total, e: total + e["tokens"]
            ).alias("tokens"),
            F.concat_ws(
                "",
                F.transform(
                    "pieces", lambda p: F.concat(p["head"], p["body"], F.lit(END))
                ),
            ).alias("formatted"),
            F.aggregate("pieces", state, step, lambda now: now["loss"]).alias("loss"),
        )
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """``conv_id, first_turn, turns, targets``: the new turns and loss texts of each window.

    Reads only the formatted text and its mask; ``turns`` are ``role, text``.
    """
    cut = F.split("formatted", END)
    new = F.slice(cut, F.col("n_repeated").cast("int") + 1, F.col("n_turns").cast("int"))
    size = len(TURN)

    def turn(piece: Column) -> Column:
        role = F.substring_index(F.substr(piece, F.lit(size + 1)), COLON, 1)
        text = F.substr(piece, F.length(role) + size + len(COLON) + 1)
        return F.struct(unescaped(role, role=True).alias("role"), unescaped(text).alias("text"))

    return formatted.select(
        "conv_id",
        "first_turn",
        F.transform(new, turn).alias("turns"),
        F.transform(
            "loss",
            lambda span: unescaped(
                F.substr(F.col("formatted"), span["start"].cast("int") + 1, span["size"].cast("int"))
            ),
        ).alias("targets"),
        F.length("formatted").cast("long").alias("chars"),
    )


def digests(formatted: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``.

    A digest is over one text, so that the turns of a conversation meet here, and only here.
    """
    lines = F.concat_ws(
        "", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    )
    parts = read_back(formatted).select(
        "conv_id",
        F.struct(
            "first_turn",
            F.size("turns").cast("long").alias("n"),
            lines.alias("lines"),
            F.concat_ws("", "targets").alias("loss"),
            "chars",
        ).alias("part"),
    )
    joined = lambda field: F.concat_ws("", F.col(f"parts.{field}"))
    total = lambda field: F.aggregate(
        F.col(f"parts.{field}"), F.lit(0).cast("long"), lambda sum_, x: sum_ + x
    )
    return (
        parts.groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("part")).alias("parts"))
        .select(
            "conv_id",
            total("n").alias("n_turns"),
            F.sha2(joined("lines"), 256).alias("turns_sha256"),
            F.length(joined("loss")).cast("long").alias("loss_chars"),
            F.sha2(joined("loss"), 256).alias("loss_sha256"),
            total("chars").alias("formatted_chars"),
        )
    )
