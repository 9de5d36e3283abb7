from quire.cli import main


def test_translate_twice(spark, tmp_path, capsys):
    docs, out, cache = (str(tmp_path / n) for n in ("docs", "out", "cache"))
    spark.createDataFrame([(1, "hola mundo\nMonto")], "doc_id long, text string").write.parquet(docs)
    (tmp_path / "e.toml").write_text('companies = ["MICM"]\n')
    (tmp_path / "g.toml").write_text('[terms]\n"Monto" = "Amount"\n')
    (tmp_path / "c.toml").write_text(f'[glossary]\nfiles = ["{tmp_path}/g.toml"]\n[entities]\nfile = "{tmp_path}/e.toml"\n')
    config = str(tmp_path / "c.toml")
    assert main(["translate", docs, out, "--cache", cache, "--config", config], spark) == 0
    assert {(r.via, r.translated) for r in spark.read.parquet(out).collect()} == {("backend", "HOLA MUNDO"), ("glossary", "Amount")}
    assert main(["translate", docs, out, "--cache", cache, "--config", config], spark) == 0
    assert {r.via for r in spark.read.parquet(out).collect()} == {"cache", "glossary"}
    assert main(["translate", docs, out, "--backend", "failing"], spark) == 1
    assert main(["translate", docs, out, "--cache", cache, "--config", config, "--dry-run"], spark) == 0
    assert main(["cache", "stats", cache], spark) == 0 and main(["audit", cache, "--config", config], spark) == 0
    assert "ok" in capsys.readouterr().out


def test_exit_codes(spark, tmp_path):
    assert main(["nothing"], spark) == 2 and main(["query", "none", "/root/testdata/sf0.001"], spark) == 2
    assert main(["query", "glossary_merge", "/root/testdata/sf0.001"], spark) == 0
    assert main(["translate", str(tmp_path), "o", "--backend", "none"], spark) == 3


def test_batch(spark, tmp_path):
    docs, out = str(tmp_path / "docs"), str(tmp_path / "out")
    rows = [("a.pdf", "pdf", 5, 1, "hola mundo"), ("b.docx", "office", 5, 2, "Monto"), ("c.txt", "copy", 5, 3, "como es"), ("d", "other", 5, 4, "nada")]
    form = "src string, kind string, mtime long, doc_id long, text string"
    spark.createDataFrame(rows, form).write.parquet(docs)
    assert main(["batch", docs, out, "--only", "pdfs"], spark) == 3
    assert main(["batch", docs, out], spark) == 0
    told = lambda run: {(r.src, r.status) for r in spark.read.parquet(f"{out}/report/run={run}").collect()}
    assert told(1) == {("a.pdf", "ok"), ("b.docx", "ok"), ("c.txt", "copied")}
    assert {r.translated for r in spark.read.parquet(f"{out}/units/run=1").collect()} == {"HOLA MUNDO", "MONTO"}
    assert [r.text for r in spark.read.parquet(f"{out}/copies/run=1").collect()] == ["como es"]
    spark.createDataFrame([("a.pdf", "pdf", 6, 1, "otra vez"), *rows[1:]], form).write.mode("overwrite").parquet(docs)
    assert main(["batch", docs, out], spark) == 0
    assert told(2) == {("a.pdf", "ok"), ("b.docx", "skipped"), ("c.txt", "skipped")}
    assert main(["batch", docs, out, "--only", "office", "--force"], spark) == 0 and told(3) == {("b.docx", "ok")}
    assert main(["batch", docs, out, "--backend", "failing", "--force"], spark) == 1


def test_cache_retry(spark, tmp_path, capsys):
    docs, out, cache = (str(tmp_path / n) for n in ("docs", "out", "cache"))
    spark.createDataFrame([(1, "hola mundo\nuna casa")], "doc_id long, text string").write.parquet(docs)
    assert main(["translate", docs, out, "--cache", cache], spark) == 0
    known = spark.read.parquet(cache).collect()
    spark.createDataFrame([(known[0].namespace, r.source, None, "failed", 9) for r in known], "namespace string, source string, en string, status string, seq long").write.mode("append").parquet(cache)
    assert main(["cache", "pending", cache], spark) == 1
    assert main(["cache", "retry", cache], spark) == 0 and "recovered 2/2" in capsys.readouterr().out
    assert main(["cache", "pending", cache], spark) == 0
    assert main(["cache", "retry", cache], spark) == 0 and "recovered 0/0" in capsys.readouterr().out


def test_config(spark, tmp_path, capsys):
    (tmp_path / ".gitignore").write_text("out")
    for _ in range(2):
        assert main(["config", "init", str(tmp_path)], spark) == 0
    assert (tmp_path / ".gitignore").read_text() == "out\nprivate/\n" and (tmp_path / "private" / ".gitignore").read_text() == "*\n"
    good, bad = tmp_path / "good.toml", tmp_path / "bad.toml"
    good.write_text('[postrules]\nsets = []\n')
    bad.write_text('[postrules]\nsets = ["none"]\n')
    assert main(["config", "validate", str(good)], spark) == 0 and main(["config", "validate", str(bad)], spark) == 3
    assert main(["config", "validate", str(tmp_path / "no.toml")], spark) == 3
    capsys.readouterr()
    assert main(["config", "show", str(good)], spark) == 0 and '"sets": []' in capsys.readouterr().out
