import json

import pytest

from caseloom.operators.cutoff import Grid
from caseloom.sources import config, files, sinks
from caseloom.streaming import ingest


def put(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(content, encoding="utf-8")
    return str(path)


def test_texts(spark, rows, tmp_path):
    put(tmp_path / "t/000012.txt", " é text \n")
    put(tmp_path / "t/abc.txt", "x")
    put(tmp_path / "t/skip.md", "x")
    put(tmp_path / "t/none.txt", "")
    texts = files.read_texts(spark, str(tmp_path / "t"))
    assert rows(texts) == [("000012", "é text"), ("abc", "x"), ("none", "")]
    wanted = spark.createDataFrame([("12",), ("abc",), ("9",)], "case_id string")
    assert rows(files.texts_of(texts, wanted)) == [("12", "é text"), ("9", ""), ("abc", "x")]
    assert rows(files.missing_texts(texts, wanted)) == [("9",)]


def test_paragraph_tree(spark, rows, tmp_path):
    put(tmp_path / "c/001/entailed_fragment.txt", "head")
    put(tmp_path / "c/001/paragraphs/002.txt", "par")
    heads, pars = files.read_paragraph_tree(spark, str(tmp_path / "c"))
    assert rows(heads) == [("001", "head")] and rows(pars) == [("001", "002", "par")]


def test_id_lists(spark, tmp_path):
    p = put(tmp_path / "ids.tsv", "5 0\n\n12.txt\tx\n5 1\n a b\n")
    get = lambda **k: [r.query_id for r in files.read_ids(spark, p, **k).orderBy("pos").collect()]
    assert get() == ["000005", "000012", "a"]
    assert get(distinct=False, normalize="none") == ["5", "12.txt", "5", "a"]
    assert get(whole_line=True, normalize="plain") == ["5 0", "12.txt\tx", "5 1", "a b"]
    assert get(limit=1) == ["000005"] and get(limit=0) == []


def test_runs(spark, rows, tmp_path):
    p = put(tmp_path / "run.trec", "1 Q0 1 1 9.0 t\n1 Q0 2 3 8.5 t\nbad line\n1 Q0 3.txt 2 8.0 t\n1 Q0 4 4 7.0 t\n2 Q0 5 1 1e-3 t\n")
    run = files.read_run(spark, p)
    assert run.count() == 5
    seven = put(tmp_path / "seven.trec", "1 Q0 2 1 9.0 t\n1 Q0 3 2 8.0 t more\n")
    assert files.read_run(spark, seven).count() == 2 and files.read_run(spark, seven, exact=True).count() == 1
    assert rows(files.run_top_k(run, 2), "query_id", "candidate_id") == [(1, 2), (1, 3), (2, 5)]
    assert rows(files.run_by_rank(run, 2), "query_id", "candidate_id") == [("000001", "000001"), ("000001", "03.txt"), ("000002", "000005")]
    out = str(tmp_path / "out")
    sinks.write_run(run, out, "tag")
    again = files.read_run(spark, out)
    assert rows(again, "query_id", "candidate_id", "rank", "score") == rows(run, "query_id", "candidate_id", "rank", "score")
    sinks.write_submission(run, str(tmp_path / "sub"), "tag")
    lines = spark.read.text(str(tmp_path / "sub"))
    assert sinks.bad_submission_lines(lines).first().asDict() == {"lines": 5, "bad": 0}
    assert sinks.bad_submission_lines(spark.createDataFrame([("a  b c",), ("é b c",), (None,), ("a b c",)], "value string")).first().bad == 3


def test_relations(spark, rows, tmp_path):
    p = put(tmp_path / "labels.json", json.dumps({"12.txt": ["3.txt", "4.txt", "3", ""], "7": "none", "8": []}))
    assert rows(files.read_relation(spark, p), "query_id", "candidate_id", "pos") == [("000012", "000003", 0), ("000012", "000004", 1)]
    assert [r.query_id for r in files.relation_queries(spark, p).orderBy("pos").collect()] == ["12", "7", "8"]
    labels = files.read_relation(spark, p, "plain")
    assert rows(files.labels_of(labels, spark.createDataFrame([("12",)], "query_id string"))) == [(12, 3), (12, 4)]
    with pytest.raises(ValueError):
        files.read_relation(spark, put(tmp_path / "list.json", "[1]"))
    relation = spark.createDataFrame([(f"{q:06}", f"{c:06}", 9 - c) for q in range(40) for c in range(q % 5)] + [('a"b', "c\\d", 0)], "query_id string, candidate_id string, pos int")
    for name, single in (("scope", False), ("one", True)):
        sinks.write_relation(relation, str(tmp_path / name), single)
        again = files.read_relation(spark, str(tmp_path / name), "none")
        assert rows(again, "query_id", "candidate_id") == rows(relation, "query_id", "candidate_id")
        assert [r.candidate_id for r in again.where("query_id = '000004'").orderBy("pos").collect()] == ["000003", "000002", "000001", "000000"]
    assert json.loads(spark.read.text(str(tmp_path / "one"), wholetext=True).first()[0])["000003"] == ["000002", "000001", "000000"]
    sinks.write_relation(relation.limit(0), str(tmp_path / "none"))
    assert rows(files.read_relation(spark, put(tmp_path / "x.json", json.dumps({"1.txt": ["2.txtx"]})), "label")) == [("1", "2x", 0)]


def test_nested_json(spark, tmp_path):
    sample = {"qry": {"qid": "1", "query": "q"}, "pos": [{"pid": "2", "passage": "p"}], "neg": []}
    assert files.read_grouped(spark, put(tmp_path / "g.json", json.dumps([sample]))).first().pos[0].pid == "2"
    assert files.read_prediction_pairs(spark, put(tmp_path / "p.json", json.dumps([{"qid": "1", "pid": "2", "qry": "a", "psg": "b"}]))).count() == 1
    assert files.read_prompts(spark, put(tmp_path / "s.jsonl", "".join(f'{{"prompt": "a{i}", "label": "b"}}\n' for i in range(9))), n=4).distinct().count() == 4
    assert files.read_prompts(spark, put(tmp_path / "t.jsonl", '{"prompt": "a", "label": "b"}\n')).first().text == "ab"
    put(tmp_path / "m/checkpoint-5/trainer_state.json", json.dumps({"global_step": 5, "log_history": [{"step": 5, "f1": 0.5}]}))
    put(tmp_path / "m/checkpoint-6/trainer_state.json", "broken")
    assert files.read_states(spark, str(tmp_path / "m")).first().log_history == [{"step": "5", "f1": "0.5"}]


def test_tables(spark, rows, tmp_path):
    p = put(tmp_path / "f.csv", "query_id,candidate_id,bm25_rank,len_diff,query_year,year_diff,label\n01,02,3,4,1999,-1,1\n")
    assert [t for _, t in files.read_features(spark, p).dtypes] == ["string", "string", "int", "float", "int", "int", "tinyint"]
    p = put(tmp_path / "p.csv", "query_id,candidate_id,pred_score,pred_rank,label\n1,2,0.5,9,\n1,3.txt,0.7,8,1\n")
    assert rows(files.read_predictions(spark, p), "query_id", "candidate_id", "label", "rank_position") == [("000001", "000002", 0, 2), ("000001", "000003", 1, 1)]
    with pytest.raises(ValueError):
        files.read_predictions(spark, put(tmp_path / "x.csv", "a,b\n1,2\n"))
    train, test = files.split_corpus(spark.createDataFrame([(f"t{i}",) for i in range(1000)], "text string"), 0.1)
    assert train.count() + test.count() == 1000 and 50 < test.count() < 160
    train, test = files.split_corpus(spark.createDataFrame([(f"t{i}",) for i in range(300)], "text string"), 0.1, shuffle=True)
    assert [r.pos for r in train.orderBy("pos").collect()] == list(range(train.count())) and [r.text for r in train.orderBy("pos").limit(3).collect()] != ["t0", "t1", "t2"]


def test_sinks(spark, rows, tmp_path):
    texts = spark.createDataFrame([("1", "a\nb"), ("2", " "), ("3", None)], "case_id string, text string")
    sinks.write_corpus(texts, str(tmp_path / "c"))
    assert rows(spark.read.json(str(tmp_path / "c")), "id", "contents") == [("1", "ab"), ("2", " "), ("3", "")]
    skipped = sinks.write_topics(texts.withColumnRenamed("case_id", "query_id"), str(tmp_path / "q"))
    assert rows(skipped) == [("2",), ("3",)] and spark.read.text(str(tmp_path / "q")).first()[0] == "1\ta b"
    row = spark.createDataFrame([("m", 5, "f", 0.1, 0.2, 0.3, "")], "model_name string, topk int, trec_file string, f1 double, precision double, recall double, notes string")
    for _ in range(2):
        sinks.append_result(row, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
    ranked = spark.createDataFrame([("q", "b", 1.0, 2), ("q", "a", 2.0, 1)], "query_id string, candidate_id string, score double, rank int")
    small = spark.createDataFrame([("q", "b", 1e-05, 2), ("q", "a", 0.0001, 1), ("q", "c", 1e16, 3)], "query_id string, candidate_id string, score double, rank int")
    assert rows(sinks.run_lines(small, "t")) == [("q Q0 a 1 0.0001 t",), ("q Q0 b 2 1e-05 t",), ("q Q0 c 3 1e+16 t",)]
    years = spark.createDataFrame([("1", 2000, "b", 1), ("1", 1990, "a", 2), ("2", -1, "missing", 3)], "case_id string, year int, year_source string, pos int")
    assert rows(sinks.year_log(years)) == [("1", 2000, "b"), ("2", -1, "missing")]
    assert sinks.candidates_by_rank(ranked).first().candidates == ["a", "b"]
    assert rows(sinks.entailment_lines(ranked)) == [("q a 2.0 1",), ("q b 1.0 2",)]


def test_config(tmp_path):
    assert [config.flag(v) for v in ("0", "No", "", "x", None)] == [False, False, False, True, False]
    assert [config.flag(v, strict=True) for v in ("Y", "x")] == [True, False]
    p = put(tmp_path / ".env", "# c\nexport A='1'\nB=\"x=y\"\nC=3\nbad\n")
    assert config.read_key_file(p, {"C": "9"}) == {"A": "1", "B": "x=y", "C": "9"}
    grid = config.cutoff_grid({"fixed_topk": {"k_values": [2]}, "remove_self": False}, {"k": "4,5", "ratio_p": "", "submission_run_tag": "t", "remove_self": "1"})
    assert (grid.k, grid.remove_self, grid.submission_run_tag, grid.ratio_p) == ((4, 5), False, "t", Grid().ratio_p)
    assert len(Grid().settings()) == 140
    with pytest.raises(ValueError):
        config.cutoff_grid([1])
    assert config.vector_source(None, None, {"processed": "p"}) == "p" and config.first_given(None, " ", "b") == "b"
    with pytest.raises(ValueError):
        config.vector_source("other", None, {"processed": "p"})


def test_stream(spark, tmp_path):
    df = spark.createDataFrame([("1", "Date: 2001\nCITATION_SUPPRESSED text", None), ("2", None, None)], ingest.SCHEMA)
    df.write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # what was read isn't read again
        ingest.start(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    out = {r.case_id: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert len(out) == 2 and (out["1"].year, out["1"].citation_num, out["2"].year, out["2"].clean_text) == (2001, 1, -1, "")
