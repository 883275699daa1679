"""Whole runs with a client that reads its answers from the sample."""

from test_edges import RESPONSES

from sourceloom import runs
from sourceloom.operators.enrich import Retry
from sourceloom.operators.pages import read_pages
from sourceloom.sources import store

AT = "2024-01-01 00:00:00"


def sample_client(responses):
    def make():
        def client(system, prompt):
            assert system is not None
            path = prompt.rsplit("\n", 1)[1]
            if path == "in/bad1.go":
                raise OSError("down")
            return responses[path]

        return client

    return make


def tree(spark):
    names = [*RESPONSES, "in/readme.md"]
    return spark.createDataFrame([(n, n) for n in names], "path string, content string")


def test_analyse_tree(spark, tmp_path):
    out = str(tmp_path / "out")
    bad, failed = runs.analyse_tree(tree(spark), sample_client(RESPONSES), out, AT, retry=Retry(retries=0))
    assert {r.path for r in bad.collect()} == {f"in/bad{i}.go" for i in range(2, 7)}
    assert [(r.path, r.error) for r in failed.collect()] == [("in/bad1.go", "OSError: down")]
    docs, refs = store.read_table(spark, f"{out}/documents"), store.read_table(spark, f"{out}/references")
    assert docs.count() == 3 and refs.count() == 4
    ids = {r.path: r.id for r in docs.collect()}
    got = {(r.source_id, r.target_id, r.type) for r in refs.collect()}
    assert (ids["in/math/calculator.go"], ids["in/math/operations.go"], "implements") in got
    pages = {r.out_path: r for r in read_pages(spark, f"{out}/pages").collect()}
    assert set(pages) == {"index.html", "components/in/main.html", "components/math/calculator.html",
                          "components/math/operations.html"}
    assert "- [Calculator](components/calculator.html)\n- [in/math](components/math.html)\n" in pages["components/in/main.html"].body_md
    assert str(pages["index.html"].last_updated) == AT

    runs.write_wiki(docs, refs, f"{out}/wiki", AT)
    wiki = {r.out_path: r.body_md for r in read_pages(spark, f"{out}/wiki").collect()}
    assert set(wiki) == {"index.html", "search.html", *(f"{p}.html" for p in ids)}
    assert wiki["in/math/calculator.go.html"].endswith(
        "\n\n## Dependencies\n\n- [in/math/operations.go](../../in/math/operations.go.html)\n")


def counting(tmp):
    def make():
        def client(_system, prompt):
            with open(tmp, "a") as log:
                log.write(prompt.rsplit("\n", 1)[-1] + "\n")
            return "# " + prompt.rsplit("\n", 1)[-1]
        return client
    return make


def test_document_tree_asks_once(spark, tmp_path):
    log, out = tmp_path / "calls", str(tmp_path / "out")
    files = spark.createDataFrame([("a/x.go", "x"), ("b.py", "y"), ("c.txt", "z"), ("d.js", "")], "path string, content string")
    rejected = runs.document_tree(files.where("path != 'b.py'"), counting(str(log)), out, AT)
    assert [(r.path, r.reason) for r in rejected.collect()] == [("d.js", "empty file content")]
    pages = {r.out_path for r in read_pages(spark, f"{out}/pages").collect()}
    assert pages == {"index.html", "components/a/x.html"}
    prompts = files.where("path like '%.go' or path like '%.py'").selectExpr("path", "content as prompt")
    more = runs.answers(prompts, counting(str(log)), f"{out}/answers")
    assert {r.path: r.response for r in more[0].collect()} == {"a/x.go": "# x", "b.py": "# y"} and more[1].isEmpty()
    assert len(log.read_text().split()) == 3  # the documentation prompt of x, and both of these
    again = runs.answers(prompts, counting(str(log)), f"{out}/answers")
    assert again[0].count() == 2 and len(log.read_text().split()) == 3


def test_changed_content_is_asked_again_on_the_same_folder(spark, tmp_path):
    log, out = tmp_path / "calls", str(tmp_path / "out")
    for text in ("old", "new"):
        runs.document_tree(spark.createDataFrame([("x.go", text)], "path string, content string"), counting(str(log)), out, AT)
    docs = store.read_table(spark, f"{out}/documents").collect()
    assert [d.content for d in docs] == ["# new"] and log.read_text().split() == ["old", "new"]
    assert "x.html" in {r.out_path.rsplit("/", 1)[-1] for r in read_pages(spark, f"{out}/pages").collect()}


def failing():
    def make():
        def client(_system, _prompt):
            raise OSError("down")

        return client

    return make


def test_runs_without_a_good_answer(spark, tmp_path):
    files = spark.createDataFrame([("x.go", "x"), ("y.go", "y")], "path string, content string")
    out = str(tmp_path / "out")
    lost = runs.document_tree(files, failing(), out, AT, retry=Retry(retries=0))
    assert {(r.path, r.reason) for r in lost.collect()} == {("x.go", "OSError: down"), ("y.go", "OSError: down")}
    bad, failed = runs.analyse_tree(files, failing(), str(tmp_path / "two"), AT, retry=Retry(retries=0))
    assert bad.isEmpty() and failed.count() == 2


def test_two_writers_of_one_version(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(3)
    assert store.write_version(rows, path) == 0
    (tmp_path / "t" / "v=1").mkdir()  # another writer is at it, or died
    assert store.write_version(rows, path) == 2 and store.current_version(spark, path) == 2


def test_two_prompts_of_one_path(spark, tmp_path):
    prompts = spark.createDataFrame([("x", "a"), ("x", "b"), ("x", "b"), ("y", "c")], "path string, prompt string")
    log, out = tmp_path / "calls", str(tmp_path / "answers")
    good, failed = runs.answers(prompts, counting(str(log)), out, in_flight=3)
    assert sorted((r.path, r.response) for r in good.collect()) == [("x", "# a"), ("x", "# b"), ("y", "# c")] and failed.isEmpty()
    assert sorted(log.read_text().split()) == ["a", "b", "c"]
    more = prompts.unionByName(spark.createDataFrame([("z", "d")], prompts.schema))
    assert runs.answers(more, counting(str(log)), out)[0].count() == 4
    assert sorted(log.read_text().split()) == ["a", "b", "c", "d"]


def test_failed_calls_are_asked_again(spark, tmp_path):
    prompts = spark.createDataFrame([("x", "a")], "path string, prompt string")
    out = str(tmp_path / "answers")
    good, failed = runs.answers(prompts, failing(), out, retry=Retry(retries=0))
    assert good.isEmpty() and failed.count() == 1
    good, failed = runs.answers(prompts, counting(str(tmp_path / "calls")), out)
    assert [r.response for r in good.collect()] == ["# a"] and failed.isEmpty()
