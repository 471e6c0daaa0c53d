"""Operator 4: planted notices are found, clean texts are left alone."""

import random
import re
import textwrap

import numpy as np
import pytest

from corpuslab.llm import licenses
from corpuslab.llm.license_texts import IDENTIFIERS, PARAGRAPHS
from corpuslab.llm.queries import queries
from tests.llm.tables import ODD_TEXTS, documents, write

#: The notices that the test tables hold.
PLANTED = {
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC",
    "This work is licensed under the GNU General Public License, version 3.": "GPL",
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "Released under the MIT License.": "MIT",
    "All rights reserved.": "Proprietary",
}


def paragraphs(text):
    return [x for x in re.split(r"\n(?:[ \t\r\f\v]*\n)+", text) if x.strip()]


@pytest.fixture(scope="module")
def model():
    return licenses.train()


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = sorted((d["doc_id"], i, PLANTED[line]) for d in docs for i, block in enumerate(paragraphs(d["text"])) for line in block.split("\n") if line in PLANTED)
    got = sorted((r["doc_id"], r["paragraph"], r["license"]) for r in queries()["op4_license_scan"](spark, sf).collect())
    assert want
    assert got == want


def test_unseen_wordings(model):
    rng = random.Random(77)
    hits = []
    for family, texts in licenses.TEMPLATES.items():
        for t in texts:
            line = " ".join(["our", "project", "is", *(w for w in t.split() if rng.random() > 0.05), "see", "below"])
            buckets, lines, _ = licenses.paragraph_features([line.encode()])
            _, p = model.probabilities(buckets, lines)
            hits.append(model.classes[p[0].argmax()] == family)
    assert np.mean(hits) >= 0.9


def test_unknown_and_near_misses(spark, model):
    texts = ["Licensed under the Foobar Public License, version 2.", "He is a licensed driver.\nThe general public was informed of the terms.", "a\n\nReleased under the MIT License.\r\nb", *ODD_TEXTS, None]
    rows = licenses.scan(documents(spark, texts), model).collect()
    assert {(r["doc_id"], r["paragraph"], r["license"], r["confirmed"]) for r in rows} == {(100_000, 0, "unknown", False), (100_002, 1, "MIT", True)}
    assert next(r["notice"] for r in rows if r["confirmed"]) == "Released under the MIT License.\r"


def test_features_are_those_of_the_plain_words():
    texts = ["Version 2.0, (GPL)!", "a.b 1.2.3 é", "", "x\ny z", "one two\nthree\n \t\n\nfour five\r\n\r\nsix", "\n\na\n\n---\n\nb"]
    for text in texts:
        buckets, found, first = licenses.paragraph_features([text.encode()])
        assert first.tolist() == [0]
        for i, block in enumerate(paragraphs(text.replace("\r", ""))):
            n = len(licenses.normal_words(block.replace("é", "e")))
            assert (found == i).sum() == sum(max(0, n - k) for k in range(licenses.LONGEST))
    each = [licenses.paragraph_features([t.encode()]) for t in texts]
    buckets, found, first = licenses.paragraph_features([t.encode() for t in texts])
    assert np.array_equal(buckets[np.lexsort((buckets, found))], np.concatenate([b[np.lexsort((b, f))] for b, f, _ in each]))
    assert first.tolist() == np.cumsum([0, *(len(paragraphs(t)) for t in texts[:-1])]).tolist()


def test_empty(spark, tmp_path):
    write(documents(spark, []), tmp_path)
    assert queries()["op4_license_scan"](spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("n", [30, 100, 1000, 20_000])
def test_notices_inside_paragraphs(spark, model, n):
    rng = random.Random(n)
    prose = lambda k: [rng.choice(licenses.FUNCTION_WORDS) if rng.random() < 0.6 else f"zqx{rng.randint(0, 10**6)}" for _ in range(k)]
    notices = [(family, t) for family, texts in licenses.TEMPLATES.items() for t in texts]
    texts, want = [], {}
    for i, (family, t) in enumerate(notices):
        before = rng.randint(0, n)
        texts += [" ".join([*prose(before), t, *prose(n - before)]), " ".join(prose(n))]
        want[100_000 + 2 * i] = family
    rows = licenses.scan(documents(spark, texts), model).collect()
    assert {r["doc_id"]: r["license"] for r in rows} == want
    assert all(r["confirmed"] and r["paragraph"] == 0 for r in rows) and len(rows) == len(want)


def test_all_notices_of_a_paragraph_are_reported(spark, model):
    between = " ".join(licenses.FUNCTION_WORDS[:60])
    rows = licenses.scan(documents(spark, [f"Released under the MIT License. {between} Licensed under CC BY-NC 4.0. {between} Released under bail."]), model).collect()
    assert [(r["license"], r["confirmed"]) for r in rows] == [("MIT", True), ("CC-BY-NC", True)]


def wrapped(text, width=70):
    return "\n".join(textwrap.wrap(text, width))


def whole_text(family, *before):
    return "\n\n".join([*before, *(wrapped(t) for t in PARAGRAPHS[family])])


FULL = {
    "MIT": whole_text("MIT", "MIT License", "Copyright (c) 2021 Jane Doe"),
    "Apache-2.0": whole_text("Apache-2.0", "Copyright 2019 The Authors"),
    "BSD": whole_text("BSD", "BSD 3-Clause License", "Copyright (c) 2020, The Project\nAll rights reserved."),
    "ISC": whole_text("ISC", "ISC License", "Copyright (c) 2004-2010 by Somebody"),
    "GPL": "\n\n".join(wrapped(t) for t in (PARAGRAPHS["GPL"][2], PARAGRAPHS["GPL"][4], PARAGRAPHS["GPL"][6])),
    "LGPL": "\n\n".join(wrapped(t) for t in (PARAGRAPHS["LGPL"][3], PARAGRAPHS["LGPL"][5], PARAGRAPHS["LGPL"][6])),
    "AGPL": "\n\n".join(wrapped(t) for t in (PARAGRAPHS["AGPL"][0], PARAGRAPHS["AGPL"][2], PARAGRAPHS["AGPL"][4])),
    "MPL-2.0": whole_text("MPL-2.0"),
    "Unlicense": whole_text("Unlicense"),
}


@pytest.mark.parametrize("comment", ["", "// ", " * "])
def test_whole_licences_are_one_notice_each(spark, model, comment):
    prose = " ".join(licenses.FUNCTION_WORDS[:40])
    texts = ["\n".join((comment + x if x else "") for x in t.split("\n")) for t in FULL.values()]
    rows = licenses.scan(documents(spark, [f"{prose}\n\n{t}\n\n{prose}" for t in texts]), model).collect()
    assert [(r["doc_id"] - 100_000, r["license"], r["confirmed"]) for r in sorted(rows)] == [(i, family, True) for i, family in enumerate(FULL)]


def test_identifiers(spark, model):
    every = [(family, x) for family, found in IDENTIFIERS.items() for x in found]
    rows = licenses.scan(documents(spark, [f"# SPDX-License-Identifier: {x}" for _, x in every]), model).collect()
    assert {r["doc_id"] - 100_000: r["license"] for r in rows} == {i: family for i, (family, _) in enumerate(every)}
    assert all(r["confirmed"] for r in rows)


def test_prose_about_rights_has_no_row(spark, model):
    texts = [
        "The work entered the public domain in 1950.", "He got his license from the state. The general public was not told, and the terms were never published.",
        "They met at the MIT campus, and the software was free of charge for them.", "Copyright (c) 2019 Jane Doe", "All seats were reserved for the people of the town.",
    ]
    assert licenses.scan(documents(spark, texts), model).collect() == []


def test_one_shared_pair_confirms_nothing(model):
    assert licenses.confirm("MIT", "the mit", False) == (0.0, "")
    assert licenses.confirm("GPL", "general public opinion was formed by the free press", False)[0] < licenses.CONFIRM
    assert licenses.confirm("MIT", "The MIT License", True)[0] == 1.0
    assert licenses.confirm("Proprietary", "All rights reserved.", False)[0] == 1.0


def test_against_plain_scoring(spark, model):
    """Windows and their probabilities by a loop over all windows, n-gram by n-gram; the notices from all of them."""
    rng = random.Random(12)
    prose = lambda k: " ".join(rng.choice(licenses.FUNCTION_WORDS) if rng.random() < 0.6 else f"zqx{rng.randint(0, 10**6)}" for _ in range(k))
    texts = [*FULL.values(), *(f"{prose(rng.randint(0, 60))}\n{t}\n{prose(rng.randint(0, 60))}" for f in list(licenses.TEMPLATES)[:8] for t in licenses.TEMPLATES[f][:2])]
    own = np.sort(np.flatnonzero(model.column >= 0))
    got = {}
    for r in licenses.scan(documents(spark, texts), model).collect():
        got.setdefault(r["doc_id"] - 100_000, []).append((r["paragraph"], r["license"], round(r["probability"], 4), r["confirmed"]))
    assert len(own)
    for d, text in enumerate(texts):
        windows, spans, at, n_line = [], [], 0, 0
        for b, block in enumerate(paragraphs(text)):
            lines = [licenses.normal_words(x) for x in block.split("\n")]
            words = [w for x in lines for w in x]
            places = [(0, len(words), licenses.PARAGRAPH)] if len(words) <= 48 else []
            begin = 0
            for x in lines:
                if x and len(x) <= 48:
                    places.append((begin, begin + len(x), licenses.LINE))
                begin += len(x)
            for width in licenses.WIDTHS:
                if len(words) > width:
                    places += [(k, min(k + width, len(words)), width) for k in range(0, len(words) - width + width // 4, width // 4)]
            for i, j, width in places:
                buckets, _, _ = licenses.paragraph_features([" ".join(words[i:j]).encode()])
                known = sorted({int(model.column[x]) for x in buckets if model.column[x] >= 0})
                if not known:
                    continue
                logits = (model.weights[known].astype(float).sum(axis=0) + model.bias) / model.temperature
                p = np.exp(logits - logits.max())
                p /= p.sum()
                if 1 - p[0] >= licenses.LEAST:
                    windows.append((b, width, at + i, at + j, np.log((1 - p[0]) / p[0]), p))
            spans += words
            at += len(words)
        found = licenses.Windows(*(np.array(x) for x in zip(*windows, strict=True)))
        have = [n for b in sorted(set(found.paragraph.tolist())) for n in licenses.notices(model, found, np.flatnonzero(found.paragraph == b), lambda i, j, spans=spans: " ".join(spans[i:j]))]
        want = [(n.paragraph, n.license, round(n.probability, 4), n.confirmed) for n in licenses.whole_notices(have)]
        assert [x[:2] + x[3:] for x in got[d]] == [x[:2] + x[3:] for x in want]
        assert [x[2] for x in got[d]] == pytest.approx([x[2] for x in want], abs=2e-3)


def test_prose_of_near_features_has_no_row(spark, model):
    prose = " ".join(licenses.FUNCTION_WORDS[40:90])
    text = f"{prose} by nd edhein erhe ston a isoringnd rendor tiou anor orlyon haly {prose}"
    assert licenses.scan(documents(spark, [text]), model).count() == 0


def test_mass_split_over_families_is_unknown(spark, model):
    texts = ["Licensed under either Apache-2.0 or MIT", "CC BY SA ND NC 4.0", "Thinly this erth und der y que."]
    rows = licenses.scan(documents(spark, texts), model).collect()
    assert [(r["doc_id"], r["license"], r["confirmed"]) for r in rows] == [(100_000, "unknown", False), (100_001, "unknown", False)]
    assert min(r["probability"] for r in rows) > 0.95
