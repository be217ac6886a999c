import random

from tests.conftest import SF_SMALL
from tests.llm import brute
from trapline.llm import quotes as Q

SCHEMA = "conv_id long, turn long, role string, text string, level int, mid string"


def threads():
    r = random.Random(4)
    line = lambda: " ".join(r.choice("alpha beta gamma delta Thanks OK".split()) + str(r.randint(0, 99)) for _ in range(r.randint(1, 5)))
    rows = []
    for c in range(12):
        texts = []
        for t in range(r.randint(1, 14)):
            out = []
            if texts and r.random() < 0.8:
                up = r.choice(texts).split("\n")
                out.append("On Monday X wrote:")
                a = r.randrange(len(up))
                some = up[a:a + r.randint(1, 5)] if r.random() < .6 else up
                if r.random() < .3:   # the client breaks lines anew
                    some = [" ".join(some[i:i + 2]) for i in range(0, len(some), 2)]
                out += [r.choice(["> ", ">", " > "]) + x.upper() if r.random() < .3 else "> " + x for x in some]
            out += [r.choice([line(), "Thanks", ""]) for _ in range(r.randint(1, 4))]
            texts.append("\n".join(out))
            rows.append((c, t, r.choice(["user", "assistant"]), texts[-1]))
    return rows


def test_links_match_brute_force(spark):
    rows = threads()
    df = spark.createDataFrame([(*x, 1, "x") for x in rows], SCHEMA).repartition(3)
    got = [(r.conv_id, r.turn, r.role, r.text, r.n_quoted, r.n_linked, r.reply_to, r.thread, r.depth, r.position) for r in Q.linked(df).collect()]
    assert sorted(got, key=str) == sorted(brute.quotes(rows), key=str)
    assert max(x[-2] for x in got) >= 3 and max(x[-1] for x in got) >= 5 and sum(x[5] for x in got) > 20


def test_nested_levels_and_cases(spark):
    rows = [(1, 0, "user", "First thing\nSecond thing"), (1, 1, "assistant", "> first  THING\nAn answer"),
            (1, 2, "user", "On 3 May A wrote:\r\n> An answer\r\n>> First thing\r\n>> unknown line\r\nMore"),
            (1, 3, "user", "> no such text"), (1, 4, "user", ">\n> --\nreal"), (None, None, None, None), (1, 1, "assistant", "> first  THING\nAn answer"),
            (2, 0, "user", "> self\nself"), (2, 1, "user", "x" * 100_000)]
    got = Q.linked(spark.createDataFrame([(*x, 1, "x") for x in rows], SCHEMA)).collect()
    assert len(got) == len(rows)
    by = {(r.conv_id, r.turn): r for r in got}
    r = by[1, 2]
    assert (r.text, r.n_quoted, r.n_linked, r.n_passages, r.reply_to, r.thread, r.depth) == ("More", 3, 2, 2, 1, 0, 2)
    assert [(q.level, q.lines, q.from_turn) for q in r.quoted] == [(1, 1, 1), (2, 2, 0)]
    assert (by[1, 1].reply_to, by[1, 1].depth, by[1, 3].reply_to, by[1, 3].n_linked, by[1, 4].n_linked, by[1, 4].text) == (0, 1, None, 0, 0, "real")
    assert by[2, 0].reply_to is None and by[None, None].text == "" and by[None, None].thread == -1
    assert len(by[2, 1].text) == 100_000
    assert Q.linked(spark.createDataFrame([], SCHEMA)).collect() == []


def links(spark, *texts):
    rows = [(1, t, "user", x, 1, "x") for t, x in enumerate(texts)]
    return {r.turn: r for r in Q.linked(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_rewrapped_passage_is_linked(spark):
    r = links(spark, "one two three four\nfive six seven", "other text", "> one two\n> three four five\n>six seven\nyes")[2]
    assert (r.n_quoted, r.n_linked, r.reply_to) == (3, 3, 0)


def test_whole_passage_goes_before_single_lines(spark):
    r = links(spark, "alpha beta\nmore here", "gamma delta\nmore there", "alpha beta\ngamma delta", "> alpha beta\n> gamma delta\nso")[3]
    assert (r.n_linked, r.reply_to) == (2, 2)


def test_latest_holder_and_partial_quotes(spark):
    got = links(spark, "same words", "same words", "> same words\nx", "first part\n\nsecond part\nits end", "> second part its end\n>\n> made up",
                "> its end\n> alien", "same words")
    assert [got[t].reply_to for t in range(7)] == [None, None, 1, None, 3, 3, None]
    assert (got[4].n_quoted, got[4].n_linked, got[5].n_linked) == (3, 1, 1)


def test_reply_order_of_a_long_chain_and_of_many_answers(spark):
    """Turns lie in several blocks, one message has most of the answers."""
    n = 2 * Q.SPAN + 300
    rows = [(1, 0, "user", "start of all", 1, "x")]
    rows += [(1, t, "user", f"> start of all\nanswer {t}", 1, "x") for t in range(1, n)]
    rows += [(2, 0, "user", "line 0", 1, "x")] + [(2, t, "user", f"> line {t - 1}\nline {t}", 1, "x") for t in range(1, 70)]
    rows += [(1, n, "user", "> answer 7\nlate", 1, "x")]
    got = {(r.conv_id, r.turn): r for r in Q.linked(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [(got[2, t].depth, got[2, t].position, got[2, t].thread) for t in range(70)] == [(t, t, 0) for t in range(70)]
    assert all(got[1, t].position == t + (t > 7) and got[1, t].depth == (t > 0) for t in range(n))
    assert (got[1, n].reply_to, got[1, n].depth, got[1, n].position) == (7, 2, 8)


def test_given_table_keeps_its_messages(spark):
    assert Q.op4(spark, SF_SMALL).count() == spark.read.parquet(f"{SF_SMALL}/conversations.parquet").count()
