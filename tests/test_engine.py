"""The engine and its command line."""

import json

from pyspark.sql import functions as F

from quarry import cli, encoders
from quarry.engine import Engine


def test_engine_and_commands(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.md").write_text("alpha beta gamma")
    (tmp_path / "src/b.md").write_text("delta epsilon zeta")
    settings = {
        "source": {"paths": [str(tmp_path / "src")], "default_extensions": [".md"]},
        "generation": {"apis": [{"id": "m", "model": "x", "api_url": "u"}]},
    }
    said = lambda url, body, headers, timeout: json.dumps({"choices": [{"message": {"content": f"{len(body['messages'][0]['content'])} characters"}}]})
    engine = Engine(spark, settings, str(tmp_path / "store"), encoders.hashing_encoder(32), 32, encoders.http_completer("u", post=said))
    ask = lambda *a: cli.run(cli.parser().parse_args(a), engine)
    assert "'chunks': 2" in ask("embed")
    assert ask("update") == "{'unchanged': 2}"
    assert engine.watch(0, rounds=2, sleep=lambda s: None) == 2
    assert "a.md" in ask("search", "alpha beta gamma").split("\n")[0]
    assert engine.context("alpha beta gamma", budget=60).select(F.contains("context", F.lit("a.md"))).first()[0]
    assert ask("chat", "alpha").endswith("characters")
    assert "'total_files': 2" in ask("stats") and ask("providers") == "m: x"
    assert ask("compact") == "done" and "-y" in ask("clear")
    assert ask("clear", "-y") == "done" and engine.stats().first().chunks == 0


def test_requests_with_history_limits_and_streams(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text("def area(r):\n    return 3 * r * r\n")
    settings = {"source": {"paths": [str(tmp_path / "src")], "default_extensions": [".py"]}}
    log = tmp_path / "log"

    def post(url, body, headers, timeout):
        with open(log, "a") as f:
            f.write(json.dumps(body) + "\n")
        if body.get("stream"):
            parts = [{"choices": [{"delta": {"content": c}}]} for c in ("three ", "parts")]
            return "".join(f"data: {json.dumps(p)}\n\n" for p in parts) + "data: [DONE]\n\n"
        return json.dumps({"choices": [{"message": {"content": "```py\nr * r<end>\n```"}}]}) if "stop" in body else json.dumps({"choices": [{"message": {"content": "ok"}}]})

    saved = tmp_path / "settings.json"
    saved.write_text(json.dumps(settings))
    engine = Engine(spark, settings, str(tmp_path / "store"), encoders.hashing_encoder(16), 16, requester=encoders.http_requester("u", post=post), settings_file=str(saved))
    engine.embed()
    turns = [("system", "Be brief."), ("user", "first?"), ("assistant", "yes"), ("user", "what is area?")]
    assert engine.complete(turns, temperature=0.2, max_tokens=50, api={"model": "m", "max_tokens_name": "limit"}) == "ok"
    assert engine.complete(turns, temperature=0.2, stream=True, api={"temperature_support": False}) == "three parts"
    first, second = map(json.loads, log.read_text().splitlines())
    assert first["model"] == "m" and first["temperature"] == 0.2 and first["limit"] == 50 and first["stream"] is False
    assert [m["role"] for m in first["messages"]] == ["system", "user", "assistant", "user"]
    assert first["messages"][1]["content"] == "first?" and "what is area?" in first["messages"][3]["content"] and "a.py" in first["messages"][3]["content"]
    assert second["stream"] is True and "temperature" not in second and "limit" not in second and "max_tokens" not in second
    engine.fill_in("def f(r):\n    return ", "\n", stops=["<end>"], temperature=0.5, max_tokens=9, prefix_name="input_prefix", suffix_name="input_suffix")
    third = json.loads(log.read_text().splitlines()[2])
    assert third["stop"] == ["<end>"] and third["temperature"] == 0.5 and third["max_tokens"] == 9 and third["input_suffix"] == "\n"
    # statistics are kept until something changes; settings are read again
    assert engine.source_stats() is engine.source_stats()
    kept = engine.source_stats()
    (tmp_path / "more").mkdir()
    (tmp_path / "more/b.py").write_text("x = 1\n")
    settings["source"]["paths"] += [str(tmp_path / "more"), str(tmp_path / "nowhere")]
    saved.write_text(json.dumps(settings))
    assert engine.update() == {"new": 1, "unchanged": 1}
    assert engine.source_stats() is not kept and engine.source_stats().first().total_files == 2
    engine.write_info(str(tmp_path / "info.json"), 8080, True, 5)
    assert json.loads((tmp_path / "info.json").read_text())["watch_interval"] == 5
