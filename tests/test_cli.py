"""The command line: answers, errors, and a state that outlives a call."""

from tracequarry.cli import main


def test_answers_and_state(spark, tmp_path, capsys):
    path, state = tmp_path / "a.log", str(tmp_path / "state")
    path.write_text('{"level":"ERROR","n":1,"t":"2026-01-01T00:00:00Z"}\n{"level":"INFO","n":2,"t":"2026-01-02T00:00:00Z"}\n')
    given = ["--watch", str(path), "--time-field", "t", "--data-dir", state]
    assert main([*given, "level = ERROR"]) == 0 and capsys.readouterr().out == '{"level":"ERROR","n":1,"t":"2026-01-01T00:00:00Z"}\n'
    # The first lines are in the state: they count after the log was rotated away.
    path.unlink()
    path.write_text('{"level":"ERROR","n":5,"t":"2026-01-03T00:00:00Z"}\n')
    assert main([*given, "| sum n"]) == 0 and capsys.readouterr().out == "8\n"
    assert main([*given, "--max-events", "1", "t > 2026-01-02T00:00:00Z | count"]) == 0 and capsys.readouterr().out == "1\n"
    assert main([*given, "--no-persist", "| count"]) == 0 and capsys.readouterr().out == "1\n"


def test_errors(spark, tmp_path, capsys):
    path = tmp_path / "a.log"
    path.write_text('{"n":1}\nbad\n')
    given = ["--watch", str(path), "--data-dir", str(tmp_path / "state")]
    for more, text in ((["n ="], "expected value"), (["n = 7 | avg n"], "no matching events"), (["--strict", "| count"], "line 2 is not valid JSON")):
        assert main([*given, *more]) == 1 and text in capsys.readouterr().err
