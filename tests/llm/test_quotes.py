"""Quotation linking: the query against SQL, and small mail threads."""

from compare import connect, difference

from matchspark.llm import queries, quotes

SCHEMA = "conv_id long, turn long, role string, text string, conv string, mark string"


def test_query_is_as_sql(spark, sf_dir):
    q = "op2_quotes"
    assert difference(queries.QUERIES[q], queries.ORACLE[q], spark, connect(sf_dir), sf_dir) is None


def threads(spark, rows):
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    return {(r["conv"], r["pos"], r["role"]): r for r in quotes.conversations(table).collect()}


def test_nested_and_partial_quotes(spark):
    rows = [
        (1, 0, "a", "First line here.\nSecond  line here."),
        (1, 1, "b", "Ann wrote:\n> First line here.\n> Second line here.\nA reply to both."),
        (1, 2, "c", "> SECOND line   here.\nOnly to the second."),
        (1, 3, "d", "> Bob wrote:\n>> First line here. Second line\n>> here.\n> A reply to both.\n\nTo the reply.\n"),
        (1, 4, "e", "> never said anywhere\nNew matter."),
        (2, 0, "f", "> A reply to both.\nSeen elsewhere."),
        (2, 1, "g", "x > y is no quote"),
    ]
    found = threads(spark, rows)
    by = {k[2]: r for k, r in found.items()}
    assert [by[x]["parent"] for x in "abcdefg"] == [None, 0, 0, 1, None, None, None]
    assert [by[x]["depth"] for x in "abcdefg"] == [0, 1, 1, 2, 0, 0, 0]
    assert [by[x]["thread"] for x in "abcdefg"] == [0, 0, 0, 0, 4, 0, 1]
    assert [by[x]["nth"] for x in "abcd"] == [0, 1, 2, 3]
    assert [by[x]["body"] for x in "bcdg"] == ["A reply to both.", "Only to the second.", "To the reply.", "x > y is no quote"]
    assert (by["d"]["n_passages"], by["d"]["n_linked"]) == (4, 2)
    assert (by["f"]["n_linked"], by["f"]["n_foreign"]) == (0, 1)
    assert by["b"]["formatted"] == "<|b|>\nA reply to both.\n"


def test_long_chain_and_hot_original(spark):
    chain = [(1, i, "u", f"say {i}" if not i else f"> say {i - 1}\nsay {i}") for i in range(300)]
    crowd = [(2, 0, "u", "the one")] + [(2, i, "u", f"> the one\nme {i}") for i in range(1, 600)]
    found = threads(spark, chain + crowd)
    for i in range(300):
        r = found[1, i, "u"]
        assert (r["depth"], r["nth"], r["thread"]) == (i, i, 0)
    for i in range(1, 600):
        r = found[2, i, "u"]
        assert (r["parent"], r["depth"], r["nth"]) == (0, 1, i)


def test_odd_rows(spark):
    rows = [
        (1, 0, "u", "hello there"), (1, 0, "u", "hello there"), (1, 0, "v", "other"), (1, 1, None, "> hello there\nyes"),
        (1, 2, "u", None), (1, 3, "u", ""), (None, 0, "u", "deep"), (None, 1, "w", "> deep\nok"), (1, None, "u", "> hello there"),
        (3, 0, "u", "word " * 30000), (3, 1, "u", "> " + "word " * 30000),
    ]
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    got = quotes.conversations(table).collect()
    assert len(got) == len(rows)
    by = {(r["conv"], r["pos"], r["role"]): r for r in got}
    assert by[1, 1, None]["parent"] == 0 and by[1, 1, None]["formatted"].startswith("<|user|>")
    assert by[None, 1, "w"]["parent"] == 0 and by[1, None, "u"]["parent"] is None
    assert by[1, 2, "u"]["body"] == by[1, 3, "u"]["body"] == ""
    assert by[3, 1, "u"]["parent"] == 0
    assert quotes.conversations(table.limit(0)).count() == 0


HEADINGS = [
    "On Mon, 1 Jan 2024, Bob Smith <bob@x.org> wrote:",
    "On Mon, 1 Jan 2024 at 10:00, Bob Smith\n<bob@x.org> wrote:",
    "On Mon, 1 Jan 2024 at 10:00,\nBob Smith of the Department\n<bob@x.org> wrote:",
    "Am 1. Januar 2024 um 10:00 schrieb Bob <bob@x.org>\nschrieb:",
    "Bob Smith <bob@x.org>\nwrote:",
    "Le lun. 1 janv. 2024, Bob " + "Smith " * 90 + "<bob@x.org> a écrit :",
    "El lun, 1 ene 2024, Bob escribió:",
    "Bob wrote:",
]


def test_headings_go_whole(spark):
    mail = []
    for i, h in enumerate(HEADINGS):
        quoted = "\n".join(f"> {line}" for line in h.split("\n"))
        mail.append((i, f"Before.\n{h}\n> said\nAfter."))
        mail.append((100 + i, f"{h}\n> mine\n{quoted}\n>> said\n> yours\nAfter."))
    mail.append((200, "On Sunday we met.\nBob wrote:\n> said\nAfter."))
    mail.append((201, "She wrote:\nno quote here"))
    mail.append((202, "> " * 30_000 + "deep\nAfter."))
    table = spark.createDataFrame(mail, "id long, text string")
    found = {r["id"]: (r["body"], r["bare"]) for r in table.select("id", quotes.own_text("text").alias("body"), quotes.bare("text").alias("bare")).collect()}
    for i in range(len(HEADINGS)):
        assert found[i] == ("Before.\nAfter.", "Before.\n> said\nAfter."), HEADINGS[i]
        assert found[100 + i] == ("After.", "> mine\n>> said\n> yours\nAfter."), HEADINGS[i]
    assert found[200][0] == "On Sunday we met.\nAfter."
    assert found[201][0] == "She wrote:\nno quote here" and found[202][0] == "After."
