"""Operator 9 on whole license texts and notices, and operator 5's recall close to its threshold."""

import random

from millrace.llm import licenses, near_dedup


def test_whole_texts_and_notices(spark):
    bsd2, bsd3 = (next(t for t, k in licenses.TEMPLATES if k == f"bsd-{n}-clause" and "SPDX" not in t) for n in (2, 3))
    by = "This work is licensed under a Creative Commons {} 4.0 International License."
    cases = {
        f"Copyright (c) 2020 Ann\n\n{licenses.MIT_WHOLE}": "mit", f"Copyright 2020\n{licenses.APACHE_WHOLE}": "apache", licenses.APACHE_GRANT: "apache", bsd2: "bsd-2-clause", bsd3: "bsd-3-clause", licenses.BSD: "bsd",
        f"{licenses.ISC}, provided that the above copyright notice and this permission notice appear in all copies.": "isc", f"{licenses.ISC}. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES": "0bsd",
        licenses.GNU.format("Affero"): "agpl,gpl", licenses.GNU.format(""): "gpl", licenses.GNU.format("Lesser"): "gpl,lgpl",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0": "epl",
        **{by.format(name): k for k, name in licenses.CREATIVE.items()}, **{f"Licensed under CC {k[3:].upper()} 4.0.": k for k in licenses.CREATIVE},
        "// SPDX-License-Identifier: MIT": "mit", "# SPDX-License-Identifier: GPL-3.0-or-later": "gpl", "SPDX-License-Identifier: BSD-3-Clause": "bsd-3-clause", "SPDX-License-Identifier: AGPL-3.0-only": "agpl", "SPDX-License-Identifier: LGPL-2.1-or-later": "lgpl",
        "SPDX-License-Identifier: Apache-2.0": "apache", "SPDX-License-Identifier: Zlib": "", "SPDX-License-Identifier: ISC": "isc", "SPDX-License-Identifier: CC-BY-NC-SA-4.0": "cc-by-nc-sa",
        "Permission to speak was hereby granted, free of charge": "", "redistribution of wealth and use in binary star forms": "",
    }
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame([(c, c) for c in cases], "doc_id string, text string")).collect()}
    assert {k: r["labels"] for k, r in got.items()} == cases
    assert all(got[by.format(name)]["score"] == 1.0 for name in licenses.CREATIVE.values())


def test_inserted_words_count(spark):
    text, filler = licenses.MIT.split(), "quite other words stand here too".split()
    cut = lambda k: " ".join(text[:10] + filler[:k] + text[10:])
    got = [r["score"] for r in licenses.scan(spark.createDataFrame([(k, cut(k)) for k in range(4)], "doc_id int, text string")).orderBy("doc_id").collect()]
    assert got[0] == 1.0 and got == sorted(got, reverse=True) and abs(got[3] - len(text) / (len(text) + 3)) < 1e-9


def test_recall_near_the_threshold(spark):
    """Pairs of sets of 4 to 2,000 shingles with a similarity from 0.80 to 0.82: the share that is linked, by size."""
    rng, rows, pairs = random.Random(9), [], {}
    for size in (4, 5, 9, 20, 50, 200, 2000):
        for k in range(200 if size < 2000 else 40):
            words = [f"w{size}x{k}x{i}" for i in range(2 * size + 20)]
            best = None
            for changed in range(size + 1):  # words at the end changed: each takes one shingle more from both sets
                a = words[: size + 3]
                b = a[: len(a) - changed] + [f"v{size}x{k}x{i}" for i in range(changed)]
                both = size - changed
                if 100 * both >= 80 * (2 * size - both):
                    best = (a, b, both / (2 * size - both))
            a, b, similarity = best
            assert similarity >= 0.8 and (similarity <= 0.83 or size < 20)
            i = len(rows)
            rows += [(i, " ".join(a)), (i + 1, " ".join(b))]
            pairs.setdefault(size, []).append(i)
    rng.shuffle(rows)
    got = {r.doc_id: r.component_id for r in near_dedup.link(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), width=4).select("doc_id", "component_id").collect()}
    recall = {size: sum(got[i + 1] == i for i in own) / len(own) for size, own in pairs.items()}
    print("recall", recall)
    assert min(recall.values()) >= 0.98, recall
