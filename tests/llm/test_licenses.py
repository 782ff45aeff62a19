"""Licence scan against all windows counted one by one."""
import random

import pyarrow as pa
import pytest

from tonecast.llm import licenses

WORDS = "the of licensed under mit license released software cc by 4 0 as is".split()
SMALL = {"A": ["Licensed under the MIT License.", "the software as is, the software as is: the software"],
         "B": ["released under the license"], "C": ["under the"], "none": ["word", ""]}


def slow(text, templates, dice):
    """Every window of a text, by its list of bigrams; then those that no better one meets."""
    words, best = licenses._WORD.findall(text.translate(licenses._LOWER)), {}
    for t, (name, own) in enumerate(licenses.ordered(templates)):
        size = sum(own.values())
        for a in range(len(words) - 1):
            for b in range(a + 2, len(words) + 1):
                bigrams = list(zip(words[a:b], words[a + 1:b]))
                if bigrams[0] not in own or bigrams[-1] not in own:
                    continue
                common = sum(min(n, bigrams.count(g)) for g, n in own.items())
                value = 2 * common / (len(bigrams) + size)
                if value >= dice and value > best.get((t, a), (0,))[0]:
                    best[t, a] = (value, b, name)
    rank = sorted((-v, a - b, t, a, b, name) for (t, a), (v, b, name) in best.items())
    kept = [x for i, x in enumerate(rank) if not any(y[3] < x[4] and y[4] > x[3] for y in rank[:i])]
    return [(name, a, b, -v) for v, _, _, a, b, name in sorted(kept, key=lambda x: (x[3], x[2]))]


@pytest.mark.parametrize("dice", [0.8, 0.6, 1.0])
def test_windows_by_brute_force(dice):
    rng = random.Random(3)
    texts = [" ".join(rng.choices(WORDS, k=rng.randrange(0, 26))) for _ in range(150)]
    texts += ["", "the", "released under the license " * 5, "software as is the " * 8, "Under. The? UNDER the"]
    got = licenses.Scanner(SMALL, dice).notices(pa.array(texts, pa.large_string()))
    assert got == [slow(t, SMALL, dice) for t in texts]
    assert any(got)


def test_blocks_of_places_change_nothing(monkeypatch):
    texts = pa.array(["Licensed under the MIT license. " * 40, None, "x"], pa.large_string()).fill_null("")
    whole = licenses.Scanner(licenses.TEMPLATES, 0.8).notices(texts)
    monkeypatch.setattr(licenses, "ROWS", 7)
    assert licenses.Scanner(licenses.TEMPLATES, 0.8).notices(texts) == whole
    assert [x[1:3] for x in whole[0]] == [(5 * k, 5 * k + 5) for k in range(40)]


def test_notices_inside_lines_and_across_them(spark):
    full = licenses.TEMPLATES
    texts = ["This project is released under the MIT License.",
             "(c) 2021 Jo. Licensed under the MIT License.",
             "Copyright 2020 Example Inc. Released under the MIT License. All rights reserved.",
             "Notes on packaging.\nReleased under\n the MIT License. The rest follows.\n",
             "x " * 50_000 + full["MIT"][3] + " y" * 50_000,
             "/* " + full["BSD-3-Clause"][2].replace(" the ", "\n * the ") + " */",
             full["GPL-2.0"][1], full["LGPL-3.0"][0], full["AGPL-3.0"][0], "A license under the sun, the mit of it.", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.licenses for r in licenses.scan(df).collect()}
    names = [[x.name for x in got[k]] for k in range(len(texts))]
    assert names == [["MIT"]] * 5 + [["BSD-3-Clause"], ["GPL-2.0"], ["LGPL-3.0"], ["AGPL-3.0"], [], [], []]
    assert texts[2][got[2][0].start:got[2][0].end] == "Released under the MIT License"
    assert texts[3][got[3][0].start:got[3][0].end] == "Released under\n the MIT License"
    assert texts[4][got[4][0].start:got[4][0].end] + "." == full["MIT"][3]


def test_no_templates(spark):
    df = spark.createDataFrame([(1, "Released under the MIT License.")], "doc_id long, text string")
    assert licenses.scan(df, {}).first().licenses == [] and licenses.scan(df, {"A": ["word"]}).first().licenses == []
