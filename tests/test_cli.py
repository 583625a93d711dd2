import io
import json

import pytest

from tessera import cli


@pytest.fixture(scope="module")
def config(tmp_path_factory):
    folder = tmp_path_factory.mktemp("cli")
    (folder / "config.json").write_text(json.dumps({"embedder": {"dim": 8}, "storage": {"data_dir": f"{folder}/data", "max_vectors": 20}}))
    (folder / "texts").mkdir()
    for name in ("b", "a"):
        (folder / "texts" / f"{name}.txt").write_text(f"text {name}")
    return folder


def run(capsys, *args):
    code = cli.main([*args])
    return code, capsys.readouterr()


def test_build_and_verbs(spark, config, capsys):
    own = ("--config", f"{config}/config.json")
    assert run(capsys, "build", f"file://{config}/texts", *own)[0] == 0
    assert json.loads(run(capsys, "search-text", "text a", "--top-k", "1", "--format", "json", *own)[1].out)[0]["name"] == "a.txt"
    assert run(capsys, "insert-vec", "--vec", "1,0,0,0,0,0,0,0", *own)[1].out.strip() == "2"
    assert run(capsys, "delete", "0", *own)[0] == 0
    code, said = run(capsys, "get", "0", *own)
    assert code == 1 and "invalid_id" in said.err
    assert run(capsys, "insert-vec", "--vec", "1,x", *own)[0] == 2
    assert run(capsys, "ping", "--config", "missing.json")[0] == 2


def test_repl(spark, config):
    from tessera.plans.collection import Collection

    c = Collection(spark, f"file://{config}/other", 8)
    out = io.StringIO()
    args = cli.parser().parse_args(["query", "--config", "x", "--format", "tsv"])
    cli.repl(c, [":ping", ":insert hello you", "hello you", ":get 7", ":what", ":replace 0 other", ":stats", ":help", "", ":q", "never"], out, args)
    lines = out.getvalue().splitlines()
    assert lines[0] == "pong" and lines[1] == "0" and lines[2].split("\t")[::2] == ["0", "hello you"]
    assert "invalid_id" in lines[3] and lines[4].startswith("unknown") and lines[5] == "ok" and json.loads(lines[6])["live_count"] == 1


def test_benchmark(spark, capsys):
    assert cli.main(["benchmark", "--base", "300", "--queries", "10", "--dim", "8", "--format", "json", "--batches", "3", "--validate", "0.9"]) == 0
    said = json.loads(capsys.readouterr().out)
    assert said["params"]["base"] == 300 and said["recall_at_k"] > 0.9
    assert said["valid"] and set(said["phases_ns"]) == {"load", "build", "warm-up", "search", "truth"} and {"p50", "p90", "p95", "p99", "mean", "max", "overflow"} == set(said["batch_latency_ns"])


def test_benchmark_of_a_data_set_against_a_report(spark, capsys, tmp_path):
    from tessera.sources.vectorfiles import write_records

    rows = [[float((i * 7 + j * j) % 11) + 0.1 for j in range(4)] for i in range(60)]
    write_records(rows, f"{tmp_path}/x_base.fvecs")
    write_records(rows[:5], f"{tmp_path}/x_query.fvecs")
    write_records([[(i + 1) % 60] * 3 for i in range(5)], f"{tmp_path}/x_groundtruth.ivecs", "ivecs")
    own = ["benchmark", "--dataset", f"file://{tmp_path}", "--top-k", "3", "--batches", "2", "--warmup", "0"]
    assert cli.main([*own, "--format", "json"]) == 0
    (tmp_path / "report.json").write_text(capsys.readouterr().out)
    said = json.loads((tmp_path / "report.json").read_text())
    assert said["params"]["dim"] == 4 and said["recall_at_k"] < 1  # the truth given is wrong
    assert cli.main([*own, "--against", f"{tmp_path}/report.json", "--validate", "1"]) == 1
    assert "valid" in (text := capsys.readouterr().out) and "against.search" in text and "slower" in text or "faster" in text
