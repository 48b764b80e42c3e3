"""A state built with ``keep`` is the one built without: each relation is written once, and read by those made of it."""

from reposcope.operators import incremental, retrieval


def test_kept_state_equals_the_plain_one(spark):
    symbols = spark.createDataFrame([(1, "f", "function", None, "a"), (2, "g", "method", "C", "b"), (3, "g", "function", None, "a")], "id int, name string, kind string, container string, file string")
    calls = spark.createDataFrame([(1, 1, "a", "g", None), (2, 2, "b", "f", "x"), (3, 1, "a", "no", None)], "call int, caller int, caller_file string, name string, receiver string")
    imports = spark.createDataFrame([("a", "g", "b", 0)], "file string, local string, target string, ord int")
    types = spark.createDataFrame([("b", "x", "C", 0)], "file string, name string, type string, ord int")
    plain, kept = (incremental.build(symbols, calls, imports, types, keep=k).relations() for k in (False, True))
    for name in plain:
        assert sorted(map(str, plain[name].collect())) == sorted(map(str, kept[name].collect())), name
        assert kept[name].inputFiles()


def test_norms_from_bodies_of_hits_are_the_same(spark):
    bodies = spark.createDataFrame([(1, "alpha beta beta"), (2, "gamma delta"), (3, "alpha gamma"), (3, "delta alpha"), (4, None)], "id int, body string")
    terms = retrieval.term_table(bodies)
    idf = retrieval.idf_table(terms, 4, 1.0)
    one, two = ({r.id: round(r.score, 9) for r in retrieval.question_scores(terms, idf, ["alpha"], bodies=b).collect()} for b in (None, bodies))
    assert one == two and set(one) == {1, 3}


def test_calls_and_their_edges_are_written_before_what_is_made_of_them(spark):
    from reposcope.plans import catalog, project

    def plan(df):
        return df._jdf.queryExecution().optimizedPlan().toString()

    assert "Window" not in plan(catalog._proposed(spark, "/root/testdata/sf0.001"))  # thrice before, for calls, imports and types
    made = plan(project._index(spark, "/root/testdata/sf0.001").calls())
    assert "Window" not in made and "Join" not in made
