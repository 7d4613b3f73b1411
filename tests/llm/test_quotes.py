"""Reply links and paths against a plain restatement on generated threads."""

import random

from folioscope.llm import quote_links

KIND = "conv_id long, turn long, role string, text string, h long, g long, path string, level int, up long"


def brute(rows):
    """(conv_id, turn, reply_to, thread, path) of each message, with ``parse`` and ``sentences`` as given."""
    said, parsed = {}, []
    for conv, turn, text in rows:
        body, quotes = quote_links.parse(text or "")
        parsed.append((conv, turn, body, quotes))
        if conv is not None and turn is not None:
            for s in quote_links.sentences(body):
                said[conv, s] = min(turn, said.get((conv, s), turn))
    parent = {}
    for conv, turn, _, quotes in parsed:
        if conv is None or turn is None:
            continue
        levels = parent.setdefault((conv, turn), {})
        for level, q in quotes:
            for s in quote_links.sentences(q):
                if said.get((conv, s), turn) < turn:
                    levels[s] = min(level, levels.get(s, level))
    up = {}
    for (conv, turn), levels in parent.items():
        votes = {}
        for s, level in levels.items():
            if level == min(levels.values()):
                votes[said[conv, s]] = votes.get(said[conv, s], 0) + 1
        up[conv, turn] = max(votes, key=lambda t: (votes[t], t)) if votes else None
    out = []
    for conv, turn, body, _ in parsed:
        path = [] if turn is None else [turn]
        while conv is not None and path and up.get((conv, path[0])) is not None:
            path.insert(0, up[conv, path[0]])
        out.append((conv, turn, body, up.get((conv, turn)), path[0] if path else None, path or None))
    return sorted(out, key=repr)


def found(spark, rows):
    frame = spark.createDataFrame([(c, t, "u", x, 1, 2, "p", 3, 4) for c, t, x in rows], KIND)
    return sorted(((r.conv_id, r.turn, r.body, r.reply_to, r.thread, r.path) for r in quote_links.link_quotes(frame.repartition(3)).collect()), key=repr)


def thread(r, conv):
    """Messages that quote earlier ones, whole or in part, wrapped or not, with what those quote."""
    texts, rows = [], []
    for turn in range(r.randrange(1, 14)):
        own = [f"Say {r.randrange(30)} of {conv}." for _ in range(r.randrange(1, 4))]
        lines = []
        for _ in range(r.choice([0, 1, 1, 2])):
            if texts:
                old = r.choice(texts)
                if r.random() < 0.5:
                    lines.append("On Monday someone wrote:")
                part = old if r.random() < 0.7 else old[r.randrange(len(old)) :]
                lines += [r.choice(["> ", ">"]) + x for x in part] + [""] * r.randrange(2)
                lines += [f"Answer {turn}."] if r.random() < 0.5 else []
        lines += own if r.random() < 0.5 else [" ".join(own)]
        texts.append(lines)
        rows.append((conv, turn, "\n".join(lines)))
    return rows


def test_generated_threads(spark):
    r = random.Random(12)
    rows = [x for conv in range(60) for x in thread(r, conv)]
    rows += [(None, 3, "> Say 1 of 2."), (2, None, "> Say 1 of 2."), (70, 0, None), (70, 1, ""), (71, 5, "> x"), rows[40], rows[41]]
    rows += [(72, 0, "Long one. " * 20_000), (72, 1, "> Long one.\nYes.")]
    want = brute(rows)
    assert sum(x[3] is not None for x in want) > 100
    assert found(spark, rows) == want


def test_no_messages(spark):
    assert found(spark, []) == []
