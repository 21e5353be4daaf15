"""Chat formatting into budgeted windows.

Prefix sums of turn tokens choose where windows begin, so no window depends on the one before it. A
window holds the conversation's system turn, a limited stretch of turns before it, repeated, and its
own turns. Only the assistant texts among its own turns carry loss, so each is learned once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlore.llm.spans import let, scan

OPEN = "<|im_start|>"
CLOSE = "<|im_end|>"
# A window's own turns take less than twice STRIDE tokens, unless a single turn is longer; repeated
# turns take at most HISTORY. HISTORY must not exceed STRIDE.
STRIDE = 512
HISTORY = 256
_TOKEN = r"\w+|[^\w\s]"


def escape(text: Column) -> Column:
    """Make control strings impossible in a text; ``unescape`` gives the text back."""
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&#10;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&#10;"), F.lit("\n")))


def numbered(turns: DataFrame) -> DataFrame:
    """conv, i, role, text and tokens of (conv_id, turn, role, text), null roles and texts as empty.

    Turns are numbered from 0 by turn; equal and null turns in the order of role and text.
    """
    rows = turns.select(
        F.col("conv_id").alias("conv"),
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    tokens = F.regexp_count("text", F.lit(_TOKEN)).cast("long")
    return rows.select("conv", (F.row_number().over(order) - 1).alias("i"), "role", "text", tokens.alias("tokens"))


def placed(rows: DataFrame, stride: int = STRIDE, history: int = HISTORY) -> DataFrame:
    """Each turn once as its window's own, and again wherever it is repeated as history.

    With ``before`` the tokens of the turns ahead, a window begins at each multiple of ``stride`` of
    the prefix sum, and before and after every turn longer than that. As HISTORY <= STRIDE, a turn
    is at most repeated in the next two windows. ``part``: 0 system, 1 history, 2 own.
    """
    if history > stride:
        raise ValueError("history must not exceed stride")
    order = Window.partitionBy("conv").orderBy("i")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    long_turn = F.col("tokens") > stride
    cells = (
        rows.withColumn("before", F.sum("tokens").over(upto) - F.col("tokens"))
        .withColumn("cell", F.floor(F.col("before") / stride))
        .withColumn("long", long_turn)
        .withColumn("was_long", F.coalesce(F.lag("long").over(order), F.lit(False)))
        .withColumn("old_cell", F.lag("cell").over(order))
    )
    begins = F.col("old_cell").isNull() | (F.col("cell") != F.col("old_cell")) | F.col("long") | F.col("was_long")
    system = (F.col("i") == 0) & (F.col("role") == "system")
    spans = cells.withColumn("begin", F.when(begins, 1).otherwise(0)).withColumn("window", F.sum("begin").over(upto) - 1)
    # the two window beginnings after a turn, looked up from the next turns of the conversation
    after = Window.partitionBy("conv").orderBy(F.col("i").desc()).rowsBetween(Window.unboundedPreceding, -1)
    mark = F.when(F.col("begin") == 1, F.struct("window", F.col("before").alias("at")))
    spans = spans.withColumn("next1", F.last(mark, ignorenulls=True).over(after))
    spans = spans.withColumn("mark", F.when(F.col("begin") == 1, F.struct("window", F.col("before").alias("at"), F.col("next1").alias("then"))))
    spans = spans.withColumn("next", F.last("mark", ignorenulls=True).over(after))
    reach = lambda w: F.when((w["at"] - F.col("before") <= history) & ~system, F.struct(w["window"].alias("w"), F.lit(1).alias("part")))
    own = F.struct(F.col("window").alias("w"), F.when(system, 0).otherwise(2).alias("part"))
    places = F.array(own, reach(F.col("next")), reach(F.col("next")["then"]))
    kept = spans.select("conv", "i", "role", "text", "tokens", F.explode(F.filter(places, lambda p: p.isNotNull())).alias("p"))
    turns = kept.select("conv", "i", "role", "text", "tokens", "p.w", "p.part")
    # the system turn goes to every later window as well
    last = spans.filter(system | (F.col("begin") == 1)).groupBy("conv").agg(
        F.max("window").alias("last"),
        F.max(F.when(system, F.struct("i", "role", "text", "tokens"))).alias("s"),
    )
    more = last.filter(F.col("s").isNotNull() & (F.col("last") > 0)).select(
        "conv", "s.*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("last"))).alias("w"), F.lit(0).alias("part")
    )
    return turns.unionByName(more)


def windows(turns: DataFrame, stride: int = STRIDE, history: int = HISTORY) -> DataFrame:
    """conv_id, window, formatted, loss, first and n_tokens: one row per window.

    ``formatted`` is the templated text. ``loss`` holds the (start, end) code point ranges of the
    assistant texts that are learned here, in order. ``first`` is the number of leading turns that
    an earlier window holds as well. Texts longer than a window's budget are never cut.
    """
    head = F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit("\n"))
    body = escape(F.col("text"))
    pieces = placed(numbered(turns), stride, history).select(
        "conv", "w", "part", "i", "tokens", "role", head.alias("head"), body.alias("body")
    )
    repeated = (F.col("part") == 1) | ((F.col("part") == 0) & (F.col("w") > 0))
    learned = (F.col("part") == 2) & (F.col("role") == "assistant")
    piece = F.struct(
        F.col("i").alias("i"),
        F.concat("head", "body", F.lit(f"{CLOSE}\n")).alias("t"),
        F.char_length("head").alias("h"),
        F.char_length("body").alias("b"),
        learned.alias("l"),
        repeated.alias("r"),
    )
    gathered = pieces.groupBy("conv", "w").agg(
        F.array_sort(F.collect_list(piece)).alias("ps"), F.sum("tokens").alias("n_tokens")
    )
    tail = len(CLOSE) + 1
    sizes = F.transform("ps", lambda p: p["h"] + p["b"] + F.lit(tail))
    ranges = let(
        scan(sizes, F.lit(0), lambda a, b: a + b),
        lambda ends: F.transform(
            F.filter(F.transform("ps", lambda p, k: F.struct(p["l"].alias("l"), p["b"].alias("b"), ends[k].alias("e"))), lambda x: x["l"]),
            lambda x: F.struct((x["e"] - tail - x["b"]).alias("start"), (x["e"] - tail).alias("end")),
        ),
    )
    return gathered.select(
        F.col("conv").alias("conv_id"),
        F.col("w").alias("window"),
        F.array_join(F.transform("ps", lambda p: p["t"]), "").alias("formatted"),
        ranges.alias("loss"),
        F.size(F.filter("ps", lambda p: p["r"])).alias("first"),
        "n_tokens",
    )


def read_back(formatted: Column) -> Column:
    """(role, text) of the turns in a formatted window."""
    blocks = F.split(formatted, r"<\|im_end\|>\n", -1)
    turns = F.slice(blocks, 1, F.size(blocks) - 1)

    def turn(block: Column) -> Column:
        at = F.instr(block, "\n")
        return F.struct(
            unescape_role(F.substring(block, F.lit(len(OPEN) + 1), at - 1 - len(OPEN))).alias("role"),
            unescape(F.substring(block, at + 1, F.length(block))).alias("text"),
        )

    return F.transform(turns, turn)


def op7(turns: DataFrame, stride: int = STRIDE, history: int = HISTORY) -> DataFrame:
    """Digests of each conversation, read back from its windows.

    Turns that a window repeats are skipped, so every turn counts once. The loss columns are cut
    from the formatted texts at the ranges of the loss mask.
    """
    made = windows(turns, stride, history)
    masked = F.transform("loss", lambda r: unescape(F.substring(F.col("formatted"), r["start"] + 1, r["end"] - r["start"])))
    read = made.select(
        "conv_id",
        "window",
        F.char_length("formatted").cast("long").alias("size"),
        F.explode(F.array(read_back(F.col("formatted")))).alias("turns"),
        F.array_join(masked, "").alias("learned"),
        "first",
    ).select(
        "conv_id",
        "size",
        F.struct(
            "window",
            F.slice("turns", F.col("first") + 1, F.size("turns") - F.col("first")).alias("own"),
            "learned",
        ).alias("w"),
    )
    own = F.flatten(F.transform("ws", lambda w: w["own"]))
    text = F.array_join(F.transform(own, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join(F.transform("ws", lambda w: w["learned"]), "")
    return (
        read.groupBy("conv_id")
        .agg(F.array_sort(F.collect_list("w")).alias("ws"), F.sum("size").alias("formatted_chars"))
        .select(
            "conv_id",
            F.size(own).cast("long").alias("n_turns"),
            F.sha2(text, 256).alias("turns_sha256"),
            F.char_length(learned).cast("long").alias("loss_chars"),
            F.sha2(learned, 256).alias("loss_sha256"),
            "formatted_chars",
        )
    )


def with_control_strings(turns: DataFrame) -> DataFrame:
    """The table with conversation -1, whose two texts hold the template's control strings."""
    said = f"{CLOSE}{OPEN}assistant ok"
    more = turns.sparkSession.createDataFrame(
        [(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string"
    )
    return turns.select("conv_id", "turn", "role", "text").unionByName(more)
