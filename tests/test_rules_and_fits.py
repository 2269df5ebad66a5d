"""Prompt rules, formulas, alignment, datasets made by several callers at once, translated Markdown."""

import re
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.operators import alignment, answers, prompts
from millrace.plans import signals, workflows
from millrace.sources import sinks, versions


def test_every_layer_of_rules_wins(spark, small):
    rows = signals.resolved_prompts(spark, small).collect()
    said = {x for r in rows for x in (r.system, re.sub(r"^<[^>]*> ", "", r.user))}
    for some in ("base system", "base user", "image system", "image user", "video user", "audio system", "p1 fallback video", "p3 fallback audio", "p0 image system", "p1 image", "p2 image by alias", "p4 audio system", "t1 system", "t1 user", "t2 system", "t3 user", "pair user", "pair system by its other name", "Sketch it.", ""):
        assert some in said, some
    assert not said & {"never", "p1 image by alias", "p1 fallback image"} and any(r.user.startswith("<") for r in rows)


def test_tasks(spark):
    own = {"change_a_to_b": "a becomes b", "combine_a_and_b": "{a}+{b}", "x": "named"}
    tasks = ["change day to night", " Change  a big b  TO a ", "combine cat with dog", "add hat to man", "x", "", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in tasks], "t string").select(prompts.task_prompt(F.col("t"), own)).collect()]
    assert got == ["day becomes night", "a big b becomes a", "cat+dog", "add hat to man", "named", "", None]


def plain_formula(text):
    """By hand, without a search for all patterns at once."""
    t = (text or "").strip(" \t\n\r\x0b\x0c")
    if not t:
        return ""
    block = lambda x: f"$$\n{x}\n$$"
    if t[:2] == "$$" and t[-2:] == "$$":
        body = t[2:-2].strip()
        return t if "$" in body else block(body)
    if t[:2] == "\\[" and t[-2:] == "\\]":
        return block(t[2:-2].strip())
    if any("\\]" in line.split("\\[", 1)[1] for line in t.split("\n") if "\\[" in line):
        return t
    dollars = [i for i, c in enumerate(t) if c == "$"]
    if any(b - a > 1 for a, b in zip(dollars, dollars[1:], strict=False)):
        return t
    command = any(c == "\\" and t[i + 1 : i + 2].isascii() and t[i + 1 : i + 2].isalpha() for i, c in enumerate(t))
    pair = lambda a, b: a in t and b in t[t.index(a) + 2 :]
    if not (command or "$$" in t and "$$" in t[t.index("$$") + 2 :] or pair("\\[", "\\]") or pair("\\(", "\\)")):
        return t
    if "usepackage" in t:
        for name in ("documentclass", "usepackage", "usepackage[]", "begin{document}", "end{document}"):
            pattern = rf"\\{name[:-2]}\[[^\]]*\]\{{[^}}]+\}}" if name.endswith("[]") else rf"\\{name}\{{[^}}]+\}}" if "{" not in name else re.escape("\\" + name)
            t = re.sub(pattern, "", t, flags=re.I)
    if t[:1] == "`" and t[-1:] == "`":
        t = t[1:-1]
    return block(t)


def test_formulas(spark):
    cores = ["x", "x^2", "\\frac{a}{b}", "a $b$ c", "", "p\nq", "\\[y\\]", "a \\] b \\[ c", "$"]
    around = [*signals.AROUND, ("$$", "$$"), ("$", "$"), ("$$$$", ""), ("$$", ""), ("\\[\n", "\n\\]"), ("see \\[\n", "\n\\] so"), ("a \\(\n", "\n\\) b"), ("\\usepackage{x}`\\q ", "`"), ("\\DocumentClass{B}\\usepackage{x} ", ""), ("`", "`")]
    texts = [a + c + b for c in cores for a, b in around] + [None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(tx.formula(F.col("t"))).collect()]
    for t, g in zip(texts, got, strict=True):
        assert g == plain_formula(t), (t, g)


def test_layout_cells(spark):
    cells = [("Page-header", None, "h"), ("Picture", [1, 2, 3, 4], None), ("Picture", [1], " p "), ("Picture", None, None), ("Text", None, "`$x$`"), ("Formula", None, "\\pi"), (None, None, "t")]
    row = spark.createDataFrame([(cells,)], "c array<struct<category:string,bbox:array<int>,text:string>>")
    assert row.select(answers.layout_markdown(F.col("c"))).first()[0] == "\n\n".join(["![](picture_0.png)", "p", "", "$x$", "$$\n\\pi\n$$", "t"])
    shown = row.select(answers.layout_markdown(F.col("c"), with_margins=True, picture=lambda c, i: F.concat(F.lit("<"), c["bbox"][2].cast("string"), F.lit(">")))).first()[0]
    assert shown.startswith("h\n\n<3>\n\np")


def planted(kind, rng):
    if kind == "homography":
        return np.array([[1.1, 0.05, 12], [-0.04, 0.93, -7], [1e-4, -2e-4, 1]])
    if kind == "affine":
        return np.array([[1.2, 0.4, 30], [-0.1, 0.7, -15], [0, 0, 1]])
    return np.array([[0.8, -0.6, 5], [0.6, 0.8, 90], [0, 0, 1]])


@pytest.mark.parametrize("kind,asked,n", [("affine_partial", "auto", 200), ("affine_partial", "affine", 5000), ("affine", "affine", 60), ("homography", "homography", 3000), ("homography", "homography", 30)])
def test_planted_transforms(spark, kind, asked, n):
    rng, rows, true = np.random.default_rng(n), [], {}
    m = planted(kind, rng)
    for pair in ("p", "q", None):
        x = rng.uniform(0, 1000, (n, 2))
        to = np.column_stack([x, np.ones(n)]) @ m.T
        to = to[:, :2] / to[:, 2:]
        false = rng.random(n) < 0.3
        true[pair] = n - int(false.sum())
        to[false] += rng.uniform(200, 900, (false.sum(), 2)) * rng.choice([-1, 1], (false.sum(), 2))
        rows += [(pair, *map(float, a), *map(float, b)) for a, b in zip(x, to, strict=True)]
    frame = spark.createDataFrame(rows + [("p", None, 1.0, 1.0, 1.0), ("p", float("nan"), 1.0, 1.0, 1.0)], "pair string, x double, y double, u double, v double").repartition(4)
    if kind == "affine" and asked == "affine":  # what a similarity cannot hold is left to it by auto's order: ask for the fit itself
        points = np.array([r[1:] for r in rows if r[0] == "p"])
        got = alignment.robust_model("affine", points, 1)
        assert np.abs(got - m).max() < 1e-6
        return
    got = alignment.aligned(frame, "pair", asked).collect()
    assert {r.pair for r in got} == {"p", "q", None}
    for r in got:
        assert r.model == kind and r.points == n and r.inliers == true[r.pair]
        assert np.abs(np.array(r.matrix).reshape(3, 3) - m).max() < 1e-6


def test_alignment_of_little(spark):
    rows = [("two", 0.0, 0.0, 1.0, 1.0), ("two", 1.0, 0.0, 2.0, 1.0)] + [("one place", 5.0, 5.0, 5.0, 5.0)] * 9 + [("three", float(i), float(i * i), float(i + 1), float(i * i)) for i in range(3)]
    got = {r.pair: r for r in alignment.aligned(spark.createDataFrame(rows, "pair string, x double, y double, u double, v double"), "pair").collect()}
    assert got["two"].model is None and got["two"].points == 2 and got["one place"].matrix is None
    assert got["three"].model == "affine_partial" and np.abs(np.array(got["three"].matrix) - [1, 0, 1, 0, 1, 0, 0, 0, 1]).max() < 1e-6
    assert alignment.aligned(spark.createDataFrame([], "pair string, x double, y double, u double, v double"), "pair").count() == 0


def test_one_dataset_of_many_callers(spark, tmp_path):
    """Callers that import at once get one dataset with one version; claims of one number have one winner."""
    root = f"file://{tmp_path}/in"
    (tmp_path / "in").mkdir()
    call = lambda i: versions.load_or_create(spark, root, "set", lambda: spark.range(100 + i).withColumn("by", F.lit(i)), tag="raw")
    with ThreadPoolExecutor(6) as pool:
        made = list(pool.map(call, range(6)))
    assert [new for _, new in made].count(True) == 1 and len({d.root for d, _ in made}) == 1
    data = made[0][0]
    assert data.latest() == 1 and data.versions().count() == 1 and len(list((tmp_path / "in" / "set" / "data").iterdir())) == 1
    again, new = versions.load_or_create(spark, root, "other", lambda: pytest.fail("nothing is imported"))
    assert not new and again.root.rstrip("/").endswith("set")
    forced, new = versions.load_or_create(spark, root, "set", lambda: spark.range(3), force=True)
    assert new and forced.latest() == 2 and forced.read().count() == 3 and forced.read("raw").count() >= 100
    with ThreadPoolExecutor(6) as pool:
        numbers = list(pool.map(lambda i: data.write(spark.range(i)), range(6)))
    assert sorted(numbers) == list(range(3, 9)) and data.versions().where("folder is null").count() == 0
    with pytest.raises(FileNotFoundError):
        versions.load_or_create(spark, f"file://{tmp_path}/none", "x", lambda: spark.range(1))


def test_translations_of_this_run_and_before(spark, tmp_path):
    root = f"file://{tmp_path}/d"
    data = versions.Dataset(spark, root)
    data.write(spark.createDataFrame([(f"/d/{i}.txt", [f"text {i}"], None) for i in range(4)], "uris string, captions array<string>, chunk_offsets array<int>"))
    new = spark.createDataFrame([("/d/0.txt", "new 0"), ("/d/1.txt", " "), ("/d/2.txt", None)], "uris string, text string")
    old = spark.createDataFrame([("/d/0.txt", "old 0"), ("/d/1.txt", "old 1"), ("/d/2.txt", "")], "uris string, text string")
    workflows.merge_translations(data, new, "translated.de", saved=old)
    got = {r.uris: (r.captions, r.chunk_offsets) for r in data.read("translated.de").collect()}
    assert got == {"/d/0.txt": (["new 0"], [5]), "/d/1.txt": (["old 1"], [5]), "/d/2.txt": (["text 2"], None), "/d/3.txt": (["text 3"], None)}
    assert workflows.merge_translations(data, new.where("text = ' '"), "none") is None
    files = spark.createDataFrame([("C:\\a\\b.docx", "x"), ("/a/.hidden", "y"), ("s3://b/c.d/e", " z\n"), ("/n", " ")], "uris string, text string")
    assert [r.path for r in sinks.translated_files(files, "zh-CN").collect()] == ["C:\\a\\b_zh_CN.md", "/a/.hidden_zh_CN.md", "s3://b/c.d/e_zh_CN.md"]
    under = sinks.translated_files(files, "pt BR", f"{tmp_path}/out")
    assert [r.path for r in under.collect()] == [f"{tmp_path}/out/{x}_pt_BR.md" for x in ("a\\b", "a/.hidden", "b/c.d/e")]
    assert sinks.write_files(under.where("path like '%/e_pt_BR.md'")).first().written and (tmp_path / "out" / "b" / "c.d" / "e_pt_BR.md").read_text().strip() == "z"
