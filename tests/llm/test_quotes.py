import random
import re

from pyspark.sql import functions as F

from inkgrid.llm import queries, quotes

MESSAGES = "conv_id long, turn long, role string, text string"


def linked(spark, rows):
    return {(row["conv_id"], row["turn"]): row for row in quotes.link_quotations(spark.createDataFrame(rows, MESSAGES)).collect()}


def test_nested_quotes_link_to_their_messages(spark):
    rows = [
        (1, 0, "user", "How do I read page two?\nIt is torn."),
        (1, 1, "assistant", "Scan it again."),
        (1, 2, "user", "> Scan it   again!\n\nI did."),
        (1, 3, "user", ">> How do I READ page two?\n> Scan it again.\nThanks\n> never said"),
        (1, 4, "assistant", "> it is torn\nSorry."),
        (1, 5, "user", ">I did.\n> Sorry.\n> sorry\nFine."),
        (2, 0, "user", "> Scan it again.\nQuotes another conversation."),
    ]
    got = linked(spark, rows)
    assert {k: row["reply_to"] for k, row in got.items()} == {
        (1, 0): None, (1, 1): None, (1, 2): 1, (1, 3): 1, (1, 4): 0, (1, 5): 4, (2, 0): None,
    }
    assert {k[1]: row["thread"] for k, row in got.items() if k[0] == 1} == {0: 0, 1: 1, 2: 1, 3: 1, 4: 0, 5: 0}
    assert got[1, 2]["text"] == "I did." and got[1, 3]["text"] == "Thanks" and got[1, 5]["text"] == "Fine."
    assert got[1, 3]["quote_levels"] == 2 and got[1, 3]["quoted_lines"] == 3 and got[1, 0]["quoted_lines"] == 0


def test_latest_of_equal_messages_and_no_self_quotes(spark):
    rows = [(1, 0, "u", "same"), (1, 1, "u", "same"), (1, 2, "u", "> same\nsame"), (1, 3, "u", "> same")]
    got = linked(spark, rows)
    assert [got[1, t]["reply_to"] for t in range(4)] == [None, None, 1, 2]


def test_long_chains(spark):
    rows = [(1, 0, "u", "line 0")] + [(1, t, "u", f"> line {t - 1}\nline {t}") for t in range(1, 120)]
    got = linked(spark, rows)
    assert all(got[1, t]["thread"] == 0 and got[1, t]["reply_to"] == t - 1 for t in range(1, 120))


def test_odd_rows_empty_tables_and_clashing_columns(spark):
    rows = [(1, 0, "u", None), (1, 1, None, ""), (None, None, None, None), (None, 3, "u", "> x\ny"), (2, 0, "u", ">>> \n>"),
            (3, 0, "u", "twice"), (3, 0, "u", "twice"), (3, 1, "u", "> twice"), (4, 0, "u", "w " * 100_000), (4, 1, "u", "> " + "w " * 100_000)]
    frame = spark.createDataFrame(rows, MESSAGES).withColumns({"reply_to": F.lit("x"), "level": F.lit(1), "n": F.lit(2)})
    out = quotes.link_quotations(frame).collect()
    assert len(out) == len(rows)
    got = {(row["conv_id"], row["turn"]): row for row in out}
    assert got[1, 0]["text"] is None and got[3, 1]["reply_to"] == 0 and got[4, 1]["reply_to"] == 0 and got[2, 0]["quoted_lines"] == 0
    assert quotes.link_quotations(frame.limit(0)).count() == 0


def test_query_keeps_every_message(spark, tmp_path):
    spark.createDataFrame([(1, 0, "u", "a"), (1, 1, "u", "> a\nb")], MESSAGES).write.parquet(f"{tmp_path}/conversations.parquet")
    out = queries.op9_quotation_linking(spark, str(tmp_path)).orderBy("turn").collect()
    assert [row["reply_to"] for row in out] == [None, 0]


def by_hand(rows):
    """(conv_id, turn) to reply_to, by looking at every earlier message of the conversation."""
    said = lambda line: " ".join(re.sub(r"[\W_]+", " ", line.lower()).split())
    level = lambda line: line[: len(line) - len(line.lstrip("> "))].count(">")
    own = [(conv, turn, [said(x) for x in text.split("\n") if level(x) == 0]) for conv, turn, _, text in rows]
    out = {}
    for conv, turn, _, text in rows:
        votes, runs, last = {}, [], None
        for line in text.split("\n"):
            here = (level(line), said(line.lstrip("> "))) if level(line) and said(line.lstrip("> ")) else None
            if here and last == here[0]:
                runs[-1][1].append(here[1])
            elif here:
                runs.append((here[0], [here[1]]))
            last = here and here[0]
        for depth, lines in runs:
            before = [(t, x) for c, t, x in own if c == conv and t < turn]
            origins = [max((t for t, x in before if line in x), default=None) for line in lines]
            words = " ".join(lines)
            if None in origins and len(words.split()) >= quotes.WORDS:
                holding = [t for t, x in before if f" {words} " in f" {' '.join(filter(None, x))} "]
                origins = [max(holding)] * len(lines) if holding else origins
            for origin in origins if depth == 1 else []:
                if origin is not None:
                    votes[origin] = votes.get(origin, 0) + 1
        out[conv, turn] = max(votes, key=lambda o: (votes[o], o)) if votes else None
    return out


def test_passages_wrapped_anew_and_parts_of_lines(spark):
    rows = [
        (1, 0, "u", "The torn page was scanned twice, on Monday and again on Friday, but nobody filed it."),
        (1, 1, "u", "Another message that says nothing of use here."),
        (1, 2, "u", "> The torn page was scanned twice, on\n> Monday and again on Friday, but nobody\n> filed it.\nI see."),
        (1, 3, "u", "> scanned twice, on Monday and again\nWhy?"),
        (1, 4, "u", "> on Monday and\ntoo short a part"),
        (1, 5, "u", ">> twice, on Monday and again on\n> Another message that\n> says nothing of use here.\nHm."),
        (1, 6, "u", "> scanned twice, on Monday but nobody filed\nnever said so"),
        (1, 7, "u", "> Another message that says\n\n> nothing of use here.\nin two passages, the second too short"),
    ]
    got = linked(spark, rows)
    assert [got[1, t]["reply_to"] for t in range(8)] == [None, None, 0, 0, None, 1, None, None]
    assert {k: row["reply_to"] for k, row in got.items()} == by_hand(rows)


def test_equals_brute_force(spark):
    r = random.Random(3)
    rows, pool = [], [" ".join(r.choices("abcd", k=r.randint(1, 9))) for _ in range(30)]
    for conv in range(12):
        texts = []
        for turn in range(14):
            text = [r.choice(pool) for _ in range(r.randint(1, 4))]
            if texts and r.random() < 0.8:
                words = " ".join(x for x in r.choice(texts).split("\n") if not x.startswith(">")).split()
                at, size, width = r.randrange(len(words)), r.randint(1, 12), r.randint(2, 6)
                part = words[at : at + size]
                text[:0] = ["> " * r.choice([1, 1, 2]) + " ".join(part[k : k + width]) for k in range(0, len(part), width)]
            texts.append("\n".join(text))
            rows.append((conv, turn, "u", texts[-1]))
    got = {k: row["reply_to"] for k, row in linked(spark, rows).items()}
    assert got == by_hand(rows) and sum(v is not None for v in got.values()) > 40
