from pyspark.sql import functions as F

from pathweave.functions import text as X
from pathweave.operators import classes
from pathweave.sources import csvtext, html, rdfxml

PAGE = '<table><tr><td><a class="uri" href="http://p/1">p1</a></td><td><ul><li><a class="uri" href="http://dbpedia.org/resource/X">X</a></li><li><span property="p" xml:lang="en">lit</span></li><li><span property="p" xml:lang="fr">non</span></li></ul></td></tr><tr><td>is <a class="uri" href="http://p/1">p1</a> of</td><td><li><a class="uri" href="http://dbpedia.org/resource/Y">Y</a></td></tr></table>'


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


def test_functions(spark):
    assert one(spark, "http://x.org/ontology/Person", X.local_name) == "Person"
    assert one(spark, "http://x.org/o#City12", X.local_name) == "City"
    assert one(spark, None, X.local_name) is None
    assert one(spark, "aXaXa", lambda x: X.count_literal(x, F.lit("aX"))) == 2 and one(spark, "a.b", lambda x: X.count_literal(x, F.lit("."))) == 1
    assert one(spark, 'a "b" \\', X.escape_quotes) == 'a \\"b\\" \\\\'
    assert one(spark, "a b+c.é\n", X.url_encode) == "a+b%2Bc%2E%C3%A9%0D%0A" and one(spark, "a%20b+c", X.url_decode) == "a b+c" and one(spark, "%zz", X.url_decode) is None
    assert one(spark, X.NAMESPACES["rdf"] + "type", X.compact_uri) == "rdf:type" and one(spark, "skos:x", X.compact_uri) == "skos:x" and one(spark, "u", X.compact_uri) == "<u>"
    assert one(spark, "SELECT * WHERE { ?a <p> ?b . FILTER (?a != ?b) }", X.bgp_text) == "?a p ?b ."
    assert one(spark, "x@R", X.side_suffix) == "R" and one(spark, "a\r\n\nb\r", X.lines) == ["a", "b"] and one(spark, " a b  a ", X.distinct_words) == ["a", "b"]
    assert one(spark, "http://d/page/X", X.data_url) == "http://d/data/X.rdf"
    assert one(spark, '<a href="https://en.example.org/wiki/Old_Quay%21" hreflang="en">', X.wiki_title) == "Old Quay!"
    assert spark.range(1).select(X.unordered_key(F.lit("P2"), F.lit("P1"))).first()[0] == "P1,P2"


def test_pages(spark):
    assert html.property_table(PAGE) == [("http://p/1", 1, "http://dbpedia.org/resource/X"), ("http://p/1", 1, "lit"), ("http://p/1", 3, "http://dbpedia.org/resource/Y")]
    assert html.property_table(None) == html.property_table("") == html.property_table("<td><p>no <table>") == []
    df = spark.createDataFrame([("e", PAGE, 1), ("n", None, 2)], "id string, page string, entity int")
    assert html.parse_pages(df, "id", "page").count() == 3


def test_rdf(spark):
    x = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:n="http://n/"><rdf:Description rdf:about="S"><n:p rdf:resource="O"/><n:q xml:lang="fr">non</n:q></rdf:Description><rdf:Description rdf:about="T"><n:p rdf:resource="S"/></rdf:Description></rdf:RDF>'
    assert rdfxml.triples(x, "S") == [("http://n/p", 1, "O"), ("http://n/p", 4, "T")]
    assert rdfxml.triples("<a", "S") is None and rdfxml.triples(None, "S") == []


def test_csv_chunks(spark):
    df = spark.createDataFrame([(1, 2, "y\r\nc,"), (1, 1, "a,b\nx,"), (1, 3, "d\n\n")], "q int, k int, t string")
    recs = csvtext.records(df, "q", "k", "t")
    assert [r.record for r in recs.orderBy("record_no").collect()] == ["a,b", "x,y", "c,d"]
    assert [tuple(r)[2:] for r in csvtext.rows(recs, "q", ["a", "b"]).orderBy("record_no").collect()] == [("x", "y"), ("c", "d")]


def test_class_scores(spark):
    facts = spark.createDataFrame([("e", "Deep Other", 2, "a deep one, so Deep"), ("f", "Shallow Other", 2, None), ("g", None, 0, None)], "entity string, type_text string, n_types int, description string")
    cands = spark.createDataFrame([("e", "Deep", 3), ("f", "Shallow", 1)], "entity string, class string, depth int")
    got = {r.entity: (r["class"], r.score) for r in classes.immediate(classes.rank_classes(cands, facts)).collect()}
    assert got == {"e": ("Deep", 13.0), "f": ("Shallow", 5.5), "g": ("Thing", 0.0)}
    assert spark.range(1).select(classes.in_domain(F.lit(None).cast("string"), ("a",))).first()[0] is False


def test_csv_rows_reads_every_header_and_form(spark, tmp_path):
    """By brute force with Python's csv module; odd records keep a row with their reason."""
    import csv

    from pathweave.suite import catalogue

    good = [(1, "s,n", "http://k/a,1"), (2, "s,n", '"http://k/b","2"\r\n'), (3, "s,p,o", 'http://k/a,http://k/p,"a, ""b""\nc"'), (4, "class,n", "x,-1"), (5, "e1,p,e2,score", "a,b,,1e3\n"), (6, "s,label,d", '"é","","2023-02-29"')]
    odd = [(7, "s,n", "http://k/a", "column_count"), (8, "s,n", '"x,1', "quoting"), (9, "s,n", None, "column_count"), (10, None, "a", "column_count")]
    rows = [(9, *r) for r in [*good, *[x[:3] for x in odd], good[0]]]
    spark.createDataFrame(rows, "query_id long, line_id long, header string, texto string").write.parquet(str(tmp_path / "sparql.parquet"))
    want = {(9, k, None, h, v) for k, header, t in good for h, v in zip(header.split(","), next(csv.reader(t.splitlines(keepends=True))))}
    want |= {(9, k, why, None, None) for k, _, _, why in odd}
    got = [(r.query_id, r.line_id, r.reason, r.variable, r.value) for r in catalogue.csv_rows(spark, str(tmp_path)).collect()]
    assert len(got) == len(want) and set(got) == want


def test_url_coding_takes_every_url(spark, tmp_path):
    """By brute force, a character at a time."""
    from pathweave.suite import catalogue

    urls = ["http://k/a_b.c", "http://k/a-b~*", "http://k/a b+c", "http://k/?q=%20&x[]=1#f", "http://k/é/\U0001f600", "", 'a"b,c']
    spark.createDataFrame([(u,) for u in [*urls, urls[0], None]], "url string").write.parquet(str(tmp_path / "client6380.parquet"))
    code = lambda c: c if c.isascii() and c.isalnum() else "+" if c == " " else "".join(f"%{b:02X}" for b in c.encode())
    assert sorted(map(tuple, catalogue.url_coding(spark, str(tmp_path)).collect())) == sorted((u, "".join(map(code, u)), u) for u in urls)


def test_text_in_pieces():
    block = lambda cls, x: f'<div class="wikibase-{cls}">{x}</div>'
    value = block("statementview-mainsnak", block("snakview-value", "12 <b>July</b>\n 1990"))
    quals = block("statementview-qualifiers", block("snakview-property", '<a href="/wiki/Property:P580">start <i>time</i></a>') + block("snakview-value", "<i>c.</i> 1740") + block("snakview-property", '<a href="/wiki/Property:P1">of</a>') + block("snakview-value", '<a href="/wiki/Q7">the <b>old</b> quay</a>'))
    page = f'<h1><span class="wikibase-title-label">Old <i>Quay</i></span></h1><div class="wikibase-statementgroupview" id="P571">{block("statementgroupview-property", "<a>incep<wbr>tion</a>")}{block("statementview", value + quals)}</div>'
    title, _, doc = html.statement_document(page)
    assert title == "Old Quay" and doc == {"P571": {"name": "inception", "list_statement": [{"url": None, "value": "12 July 1990", "list": [["P580", "start time", "c. 1740"], ["P1", "of", "Q7", "the old quay"]]}]}}
