"""Chat threads from quotations.

Each message is cut into its own text and its quoted passages by level (leading ``>``
signs, blanks between allowed; attribution lines right before a quotation go with it).
Normalised quoted sentences are hashed and joined with the hashes of what earlier
messages of the conversation say themselves; of those with hits at the outermost level that
has any, the message with most is the parent.  Parents are followed up to the message that opens
the thread; conversations are the messages' own texts in the order of these reply paths.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stages import lean, materialize, table

_QUOTED = re.compile(r"^[ \t]{0,3}((?:>[ \t]?)+)(.*)$")
_INTRO = re.compile(r"^.{1,200}\b(?:wrote|writes|said|schrieb|écrit|escribió)\s*:\s*$", re.I)
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n{2,}")


def parse(text: str) -> tuple[str, list[tuple[int, str]]]:
    """A message without its quotations, and those as (level, text), in order."""
    own: list[str] = []
    quotes: list[tuple[int, list[str]]] = []
    last = 0
    for line in text.split("\n"):
        m = _QUOTED.match(line.rstrip("\r"))
        level = m[1].count(">") if m else 0
        if not m:
            own.append(line)
        else:
            if not last:  # an attribution, and blank lines after it, go
                k = len(own)
                while k and not own[k - 1].strip():
                    k -= 1
                if k and _INTRO.match(own[k - 1].strip()):
                    del own[k - 1 :]
            if last != level:
                quotes.append((level, []))
            quotes[-1][1].append(m[2])
        last = level
    return "\n".join(own).strip() if quotes else text, [(n, "\n".join(x)) for n, x in quotes]


def sentences(text: str) -> list[str]:
    """Normalised sentences with a letter or digit: lower case, single blanks."""
    out = (" ".join(s.lower().split()) for s in _SENTENCE.split(text))
    return list(dict.fromkeys(s for s in out if any(c.isalnum() for c in s)))


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("body", pa.string()), ("own", pa.list_(pa.string())), ("quoted", pa.list_(pa.struct([("s", pa.string()), ("level", pa.int32())]))), ("depth", pa.int32())])
    for batch in batches:
        rows = []
        for value in batch.column(3):
            body, quotes = parse(value.as_py() or "")
            quoted: dict[str, int] = {}
            for n, q in quotes:
                for s in sentences(q):
                    quoted[s] = min(n, quoted.get(s, n))
            rows.append((body, sentences(body), [{"s": s, "level": n} for s, n in quoted.items()], max([0, *(n for n, _ in quotes)])))
        if rows:
            more = [pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), list(schema)[3:], strict=True)]
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), *more], schema=schema)


def reply_paths(links: DataFrame) -> DataFrame:
    """(conv_id, turn, path) of links (conv_id, turn, reply_to): the turns from the thread's first to ``turn``.

    Every round doubles the steps that a path covers.  Parents are earlier turns, so there are
    no cycles.  A chain of n replies holds n * n / 2 turns in all.
    """
    now = links.select("conv_id", "turn", F.col("reply_to").alias("up"), F.array("turn").alias("path"))
    while not now.where("up is not null").isEmpty():
        above = now.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("next"), F.col("path").alias("head"))
        now = now.join(above, ["conv_id", "up"], "left")
        path = F.when(F.col("up").isNull(), F.col("path")).otherwise(F.concat(F.coalesce("head", F.array("up")), "path"))
        now = materialize(now.select("conv_id", "turn", F.col("next").alias("up"), path.alias("path")), "paths")
    return now.select("conv_id", "turn", "path")


def link_quotes(messages: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, body, quote_depth, n_quoted, n_linked, reply_to, thread, path) of every message.

    ``reply_to`` is the turn of the earlier message of the conversation that most of the
    sentences quoted at level 1 come from (ties: the latest); deeper levels, the history that
    the parent quotes itself, count only where no level above links.  A sentence comes from
    the first message that says it unquoted, and has the lowest level it is quoted at.  ``path`` has
    the turns from the one that opens the thread, ``thread``, down to the message: in order of
    (conv_id, path) each reply stands below what it answers.  Null texts count as empty; messages with a null
    conversation or turn link with nothing; rows that repeat (conv_id, turn) share their
    links; other columns are ignored; an empty table gives no rows.
    """
    rows = messages.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).alias("text"))
    kind = "conv_id long, turn long, role string, body string, own array<string>, quoted array<struct<s:string,level:int>>, depth int"
    parsed = materialize(rows.mapInArrow(lean(_parsed), kind), "messages")
    quoted = parsed.where(F.size("quoted") > 0).select("conv_id", "turn", F.inline("quoted"))
    quoted = quoted.groupBy("conv_id", "turn", F.xxhash64("s").alias("h"), F.xxhash64(F.reverse("s")).alias("g")).agg(F.min("level").alias("level"))
    quoted = materialize(quoted, "quoted")
    asked = quoted.select("conv_id").distinct()
    said = parsed.join(asked, "conv_id", "left_semi").select("conv_id", "turn", F.explode("own").alias("s"))
    said = said.groupBy("conv_id", F.xxhash64("s").alias("h"), F.xxhash64(F.reverse("s")).alias("g")).agg(F.min("turn").alias("first"))
    said = materialize(said, "said")
    hits = quoted.join(said, ["conv_id", "h", "g"]).where("first < turn").groupBy("conv_id", "turn", "level", "first").agg(F.count("*").alias("n"))
    best = hits.groupBy("conv_id", "turn").agg(F.sum("n").alias("n_linked"), F.max(F.struct(-F.col("level"), "n", "first")).getField("first").alias("reply_to"))
    best = materialize(best, "best")
    best = best.join(reply_paths(best), ["conv_id", "turn"])
    out = parsed.join(best, ["conv_id", "turn"], "left").withColumn("path", F.coalesce("path", F.when(F.col("turn").isNotNull(), F.array("turn"))))
    return out.select("conv_id", "turn", "role", "body", F.col("depth").alias("quote_depth"), F.size("quoted").cast("long").alias("n_quoted"), F.coalesce("n_linked", F.lit(0).cast("long")).alias("n_linked"), "reply_to", F.get("path", F.lit(0)).alias("thread"), "path")


def conversations(linked: DataFrame) -> DataFrame:
    """The messages of ``link_quotes`` as conversations: sorted by reply path, ``body`` without quotes."""
    return linked.orderBy("conv_id", "path")


def op9_quote_links(spark, sf_dir: str) -> DataFrame:
    return conversations(link_quotes(table(spark, sf_dir, "conversations")))


#: Line-wise parsing with state isn't expressed in SQL; tested against brute force.
QUERIES, ORACLES = {"op9_quote_links": op9_quote_links}, {}
