import glob
import hashlib
import json
import os

import pytest
from crawl_fixtures import HTML, one_crawl, page, responses

from wavecrawl.operators.sinks import export_page_files, page_documents, write_corpus
from wavecrawl.plans.crawl import crawl
from wavecrawl.session import new_run_dir

G = "https://docs.example.com/guide/"


def _site(spark):
    return responses(spark, [
        (G + "intro", G + "intro", 200, HTML,
         page("Intro", "Kilns are fired on Mondays, and glazed bowls cool slowly until Thursday.",
              '<a href="/guide/intro-2">Second</a><a href="/guide/missing">gone</a>')),
        (G + "intro-2", G + "intro-2", 200, HTML,
         page("Intro", "Clay from the river bank is washed, sieved and left to dry.")),
    ])


def test_write_corpus_pages_and_manifest(spark):
    out = crawl(one_crawl(spark, G + "intro"), _site(spark))
    root = new_run_dir(spark, "corpus")
    write_corpus(out.page_results, out.scopes, root)
    pages = spark.read.parquet(f"{root}/pages")
    assert sorted(r.output_path for r in pages.collect()) == ["guide/intro-2.md", "guide/intro.md"]
    summary = [json.loads(line) for f in glob.glob(f"{root}/manifest/summary/*.json") for line in open(f)]
    assert len(summary) == 1
    s = summary[0]
    assert s["seed_url"] == G + "intro" and s["scope"] == {"base_url": G, "mode": "path"}
    assert s["summary"]["total"] == 3 and s["summary"]["succeeded"] == 2 and s["summary"]["failed"] == 1
    results = spark.read.json(f"{root}/manifest/results")
    assert "content" not in results.columns and results.count() == 3
    files_root = new_run_dir(spark, "files")
    export_page_files(page_documents(out.page_results), files_root)
    text = open(os.path.join(files_root, "pages", "1", "guide", "intro.md"), encoding="utf-8").read()
    assert text.startswith('---\ntitle: "Intro"\n') and "sourceUrl: " in text


def test_write_corpus_single_file(spark):
    out = crawl(one_crawl(spark, G + "intro"), _site(spark))
    root = new_run_dir(spark, "merged")
    write_corpus(out.page_results, out.scopes, root, single_file=True)
    parts = sorted(glob.glob(f"{root}/merged/crawl_id=1/part-*"))
    doc = "".join(open(p, encoding="utf-8").read() for p in parts)
    assert doc.startswith("# docs.example.com\n")
    assert doc.index("- [Intro](#intro)") < doc.index("- [Intro](#intro-2)") < doc.index('<a id="intro"></a>')


def _files(root):
    return sorted(os.path.relpath(f, root) for f in glob.glob(f"{root}/**", recursive=True) if os.path.isfile(f))


def test_page_files_commit_rerun_and_failure(spark):
    root = new_run_dir(spark, "page-files")
    rows = [(1, f"a/p{k}.md", f"text {k}") for k in range(20)] + [(2, "../up.md", "é"), (2, "empty.md", None)]
    docs = spark.createDataFrame(rows, "crawl_id long, output_path string, markdown string").repartition(4)
    export_page_files(docs, root, run="one")
    want = sorted([f"1/a/p{k}.md" for k in range(20)] + ["2/%2E%2E/up.md", "2/empty.md", "_SUCCESS"])
    assert _files(f"{root}/one") == want
    assert json.load(open(f"{root}/one/_SUCCESS")) == {"files": 22, "bytes": sum(len((m or "").encode()) for _, _, m in rows)}
    export_page_files(docs.limit(1).selectExpr("crawl_id", "'new.md' output_path", "'x' markdown"), root, run="two")
    export_page_files(docs.selectExpr("crawl_id", "output_path", "concat('again ', markdown) markdown"), root, run="one")
    assert _files(f"{root}/one") == want and open(f"{root}/one/1/a/p3.md").read() == "again text 3"
    assert "new.md" in _files(f"{root}/two")[0]
    # the task that holds p7 fails after other rows of it were written: none of its files is visible
    broken = docs.coalesce(1).selectExpr("crawl_id", "output_path", "if(output_path = 'a/p7.md', raise_error('lost'), markdown) markdown")
    with pytest.raises(Exception, match="lost"):
        export_page_files(broken, root, run="three")
    assert _files(f"{root}/three") == []


def test_page_files_read_back_in_tasks(spark):
    from wavecrawl.operators.sinks import read_page_files

    root = new_run_dir(spark, "files-back")
    docs = spark.createDataFrame([(1, "d/1.md", "one"), (1, "x/y.md", ""), (2, "d/2.md", "zwei ä")], "crawl_id long, output_path string, markdown string")
    export_page_files(docs, root)
    crawls = spark.createDataFrame([(1,), (2,), (3,)], "crawl_id long")
    got = {(r.name, r.n_bytes, r.sha256) for r in read_page_files(crawls, root).collect()}
    assert got == {(f"{c}/{p}", len(t.encode()), hashlib.sha256(t.encode()).hexdigest()) for c, p, t in
                   [(1, "d/1.md", "one"), (1, "x/y.md", ""), (2, "d/2.md", "zwei ä")]}
