import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

EXTRA = "id string, rid1 string, rid2 string, hit int, spans int, score int, copy_no int, `row` int, found int, body int, node int, root int, label string"


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text, source): passages and copies of all kinds, and the odd cases."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, page = text(60), text(400)
    out = [(i, text(rng.randrange(3, 200))) for i in range(40)]
    out += [(100 + i, text(40) + " " + passage + "\n" + text(30)) for i in range(12)]
    for i in range(25):  # near copies of one page, some beyond the threshold
        w = page.split()
        for _ in range(rng.randrange(0, 14)):
            w[rng.randrange(len(w))] = word()
        out.append((200 + i, " ".join(w)))
    out += [(300 + i, page.upper() if i == 3 else page) for i in range(5)]  # exact copies
    out += [(400, text(5)), (401, text(4)), (402, "one two"), (403, "ONE\ttwo"), (404, "ha " * 500), (405, text(9000))]
    out += [(500, None), (501, ""), (502, " \n\t"), (None, "no id " + passage), (None, None), (503, "...!!"), (504, "éü " * 300)]
    out += [(600, page), (600, page), (601, text(50))]  # repeated rows
    out += [
        (700, "Mail jo.x@a-b.example.org or 10.0.0.255, call +1 (555) 010-9999; card 4111 1111 1111 1111 and 4111-1111-1111-1112."),
        (701, "€ 1.2.3.4.5 999.1.1.1 a@b@c.de x@y x.y@z.. +49 30 1234567 \U0001f600 a@b.c_d@e.fg " + "1 " * 60 + "4111111111111111"),
        (702, "a" * 5000 + "@" + "b." * 2000 + "c " + "1." * 3000 + "1 " + "+1" * 500),
        (703, "CC BY and cc-by; the General Public License. All rights reserved, ALL RIGHTS RESERVED ccé by"),
    ]
    return [(i, t, ["web", "book", None][k % 3]) for k, (i, t) in enumerate(out)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    extra = ("x", "y", "z", 1, 2, 3, 4, 5, 6, 7, 8, 9, "w")
    table = [(i, t, None if t is None else "en", s, None if t is None else len(t), *extra) for i, t, s in rows]
    return spark.createDataFrame(table, f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}").repartition(5).cache()


@pytest.fixture(scope="session")
def pairs(rows):
    return [(i, t) for i, t, _ in rows]


def as_key(row):
    return tuple((x is None, str(x)) for x in row)


@pytest.fixture
def same():
    def check(got, want):
        assert sorted((tuple(r) for r in got), key=as_key) == sorted((tuple(r) for r in want), key=as_key)

    return check
