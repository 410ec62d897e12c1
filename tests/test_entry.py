"""The driver's contract."""

import subprocess
import sys

from conftest import ROOT


def test_names_agree():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.queries()) > 60


def test_without_the_training_operators(tmp_path):
    """The library imports and lists its queries where the folders of the training-data operators are gone."""
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name in ('corpus_pipeline', 'proselab.llm') or name.startswith('proselab.llm.'):\n"
        "            raise ImportError(name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert not any(n.startswith('op1_') or n == 'pipeline' for n in e.queries()) and 'fingerprint' in e.queries()\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_command_line(spark, capsys):
    from proselab import cli

    assert cli.main(["scrub", "It is late."], spark).first()["rewrite"] == "It's late."
    assert "Aggregate" in cli.main(["patterns", "It is late."], spark).first()["report"]


def test_all_commands(spark, tmp_path):
    import json

    from proselab import cli

    text = "Furthermore, it is a robust plan. It is not late. They are ready, but nobody has seen the crucial page."
    assert 0 <= cli.main(["detect", text], spark).first().p_ai <= 1
    r = cli.main(["pipeline", text], spark).first()
    assert "Furthermore" not in r.bursty and r.similarity > 0.5
    for command in ("humanize", "reject"):
        r = cli.main([command, text, "--candidates", "2", "--threshold", "0.9"], spark).first()
        assert r.passed is not None and r.attempts == 2
    (tmp_path / "s.jsonl").write_text("\n".join(json.dumps({"source": f"{text} {k}"}) for k in range(3)))
    s = cli.main(["eval", str(tmp_path / "s.jsonl"), "--samples", str(tmp_path / "samples")], spark).first().summary
    assert s.startswith("n=3\n") and "asr_per_detector" in s and spark.read.json(str(tmp_path / "samples")).count() == 3
    rows = [{"ai": "w " * n, "human": "v " * 60, "source": "s", "prompt_idx": 0, "human_idx": n} for n in (10, 60, 500)]
    (tmp_path / "p.jsonl").write_text("\n".join(map(json.dumps, rows)))
    assert [r.human_idx for r in cli.main(["prepare-data", str(tmp_path / "p.jsonl"), str(tmp_path / "out")], spark).collect()] == [60]
