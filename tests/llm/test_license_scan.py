import random
import re

from pyspark.sql import functions as F

from tidemark.llm import license_rules, license_scan

BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def brute_base(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    at = [(i, label) for phrase, label in BASE.items() for i in range(len(words)) if words[i : i + len(p := phrase.split())] == p]
    return len(words), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


TEXTS = [
    None, "", "the mit", "Released under the MIT License.", "Licensed under the Apache License, Version 2.0 and under the MIT license; CC BY-NC 4.0",
    "under the mit license " * 400, "undertheMITlicense under-the\nMIT  LICENSE", "cc by nc sa 4 0", "SPDX-License-Identifier: GPL-3.0-or-later", "3-clause BSD license",
    "This work is licensed under the GNU General Public License, version 3", "license " * 3000, "é under the MIT licenseé under the MIT license", "cc by cc by nc cc by nc",
    "x " * 20000 + "cc-by-nc", "apache license version 20",
]


def scanned(spark, texts):
    rows = [(i, t, "clash") for i, t in enumerate(texts)]
    return {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string, words string")).collect()}


def test_base_places(spark):
    for i, r in scanned(spark, TEXTS).items():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_base(TEXTS[i]), TEXTS[i]
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_suppression_and_labels(spark):
    got = scanned(spark, TEXTS)
    assert got[9].labels == "bsd-3-clause" and got[8].labels == "gpl-3" and got[8].score == 1.0
    assert got[10].labels == "gpl-3" and [d.stop - d.start for d in got[10].detections] == [9]
    assert got[7].base_labels == "cc-by-nc" and got[7].labels == "cc-by-nc,cc-by-nc-sa"
    assert got[0].labels == "" and got[0].score == 0


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(None, "cc by nc"), (1, "cc by nc"), (1, "cc by nc")], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in license_scan.scan(df).collect()) == ["1", "1", "None"]
    assert license_scan.scan(df.limit(0)).collect() == []


def test_rules_are_many_and_sound():
    assert len(license_rules.RULES) > 300
    for r in license_rules.RULES:
        re.compile(r.pattern)
        assert r.pattern.count("|") >= 1 and r.key


def samples(pattern):
    """Matches of a pattern: the shortest, the longest, and those of every branch of a choice."""

    def made(parsed, most, branch):
        out = ""
        for op, arg in parsed:
            name = str(op)
            if name == "LITERAL":
                out += chr(arg)
            elif name == "NOT_LITERAL":
                out += "x"
            elif name == "IN":
                kind, value = arg[0]
                out += chr(value if str(kind) == "LITERAL" else value[0])
            elif name == "MAX_REPEAT":
                out += made(arg[2], most, branch) * (max(arg[0], min(arg[1], 3)) if most else arg[0])
            elif name == "SUBPATTERN":
                out += made(arg[3], most, branch)
            else:
                assert name == "BRANCH", name
                out += made(arg[1][branch % len(arg[1])], most, branch)
        return out

    return {made(re._parser.parse(pattern), most, branch) for most in (False, True) for branch in range(12)}


def test_keys_are_words_of_every_match():
    for r in license_rules.RULES:
        assert re.fullmatch("[0-9a-z]+", r.key), r
        for s in samples(r.pattern):
            assert re.fullmatch(r.pattern, s) and r.key in s, (r, s)


def test_rules_with_an_optional_space(spark):
    texts = ["released under the OpenRAIL-M license", "the CreativeML Open RAIL-M License", "open rail licence", "beerware license", "under the Beer-Ware License"]
    assert [r.labels for _, r in sorted(scanned(spark, texts).items())] == ["openrail"] * 3 + ["beerware"] * 2


def test_outermost_like_all_pairs(spark):
    """Of random detections, more than several blocks of them in a row: those that no earlier or better one contains."""
    rng = random.Random(4)
    kind = "array<struct<start:int,behind:int,priority:int,label:string,weight:double,base:boolean>>"
    rows = [sorted((s, -(s + rng.randint(1, 30)), rng.randint(0, 3), rng.choice("ab"), 0.5, False) for s in (rng.randint(0, n) for _ in range(n))) for n in (0, 1, 5, 255, 256, 257, 1500)]
    rows.append(sorted([(0, -10_000, 0, "a", 0.5, False)] + [(i, -(i + 2), 1, "b", 0.5, False) for i in range(2000)]))
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"id int, found {kind}")
    for r in df.select("id", license_scan._outermost(F.col("found")).alias("kept")).collect():
        found = rows[r.id]
        assert [tuple(d) for d in r.kept] == [d for i, d in enumerate(found) if not any(e[1] <= d[1] for e in found[:i])]
