import random

from versoflow.llm import spam

WORDS = "river stone garden window carpet violin harbour lantern meadow orchard thunder saddle mirror castle pencil barrel clerk dairy eclipse ferry granite hinge ivory jacket kettle ladder margin needle otter parcel".split()
VERBS = "crossed found opened kept painted buried measured forgot praised sold carried washed".split()
FORMS = [
    "The {a} of the {b} was not in the {c}.", "Nobody {v} a {a} before the {b} had been there.", "When {a} and {b} met, they {v} the {c} at once.", "In those days every {a} {v} its {b}, but no {c} did.",
    "She {v} the {a}; her brother, who had a {b}, did not.", "Was it the {a} that {v} us, or the {b}?", "From the {a} to the {c} it is as far as from {b} to {b}.",
]


def prose(rnd, n=14):
    return " ".join(rnd.choice(FORMS).format(a=rnd.choice(WORDS), b=rnd.choice(WORDS), c=rnd.choice(WORDS), v=rnd.choice(VERBS)) for _ in range(n))


def pages():
    rnd = random.Random(3)
    good, bad = {}, {}
    for k in range(12):
        good[f"prose{k}"] = prose(rnd)
    good["links"] = prose(rnd, 20) + "\n" + "\n".join(f"https://a{i}.example/x/{i}" for i in range(4))
    good["contents"] = "Contents\n" + "\n".join(f"{i}. Letters from {rnd.choice(WORDS)} ..... {7 * i}" for i in range(1, 25))
    good["index"] = "Index\n" + "\n".join(f"{w}, {', '.join(str(rnd.randrange(400)) for _ in range(4))}" for w in WORDS)
    good["verse"] = "\n".join(f"{prose(rnd, 2)}\nO {rnd.choice(WORDS)} in the night of old" for _ in range(8))
    good["none"], good["empty"], good["blank"] = None, "", " \n\t "
    keys = ["vintage ledger", "gilt edges", "antique map"]
    bad["words"] = prose(rnd, 1) + "\n" + ", ".join(rnd.choice(keys) for _ in range(90))
    bad["named"] = " ".join(f"{rnd.choice(keys)} {rnd.choice(WORDS).title()}{i}" for i in range(60))
    bad["offers"] = "\n".join(f"SKU {rnd.randrange(9999)} {rnd.choice(keys)} A5 in stock, add to basket" for _ in range(30))
    bad["linklist"] = "\n".join(f"{rnd.choice(WORDS).title()}: https://www.b{i}.example/{rnd.choice(WORDS)}/x.html" for i in range(30))
    bad["tags"] = " ".join(f"#{rnd.choice(WORDS)}{rnd.choice(WORDS)}" for _ in range(60))
    bad["disguised"] = ", ".join(rnd.choice(["vіntаge ledgеr", "gіlt еdges"]) for _ in range(60))
    return good, bad


def frame(spark, texts):
    rows = [(k, t, f"host{k % 5}", "x") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, h string")


def test_flags_spam_and_nothing_else(spark):
    good, bad = pages()
    names = [*good, *bad]
    got = {names[r.doc_id] for r in spam.spam_pages(frame(spark, [*good.values(), *bad.values()])).collect()}
    assert got == set(bad)


def test_copied_prose_on_many_hosts_is_no_spam(spark):
    rnd = random.Random(9)
    text = prose(rnd)
    assert spam.spam_pages(frame(spark, [text] * 8)).count() == 0
    assert spam.spam_evidence(frame(spark, [text] * 8)).where("listed > 0.4 * n").count() == 0


def test_replicated_phrases_count_hosts_not_pages(spark):
    phrase = "seldom crowded lantern merchants gather."
    one = spark.createDataFrame([(k, phrase, "same") for k in range(9)], "doc_id bigint, text string, source string")
    many = spark.createDataFrame([(k, phrase, f"h{k}") for k in range(3)], "doc_id bigint, text string, source string")
    assert spam.spam_evidence(one).where("replicated > 0").count() == 0
    assert spam.spam_evidence(many).where("replicated > 0").count() == 3


def test_null_ids_empty_tables_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, "a", "h"), (1, ", ".join(["gilt edges"] * 40), None), (1, ", ".join(["gilt edges"] * 40), None)], "doc_id bigint, text string, source string")
    assert [r.doc_id for r in spam.spam_pages(df).collect()] == [1]
    assert spam.spam_pages(df.where("false")).count() == 0


def test_phrases_shifted_by_a_word_and_short_phrases_count(spark):
    phrase = "seldom crowded lantern merchants gather pewter spoons"
    shifted = [phrase, "today " + phrase, "blue heavy " + phrase]
    mk = lambda texts: spark.createDataFrame([(k, t, f"h{k}") for k, t in enumerate(texts)], "doc_id bigint, text string, source string")
    size = sum(map(len, phrase.split()))
    assert [r.replicated for r in spam.spam_evidence(mk(shifted)).orderBy("doc_id").collect()] == [size] * 3
    lists = ["gilt edges, antique map\nledger", "ledger, gilt edges, other thing", "antique map, gilt edges, ledger"]
    assert [r.replicated for r in spam.spam_evidence(mk(lists)).orderBy("doc_id").collect()] == [15, 15, 15]


def test_replicated_is_the_union_found_by_brute_force(spark):
    rnd = random.Random(5)
    docs = [", ".join(" ".join(rnd.choice("abcdef") * 3 for _ in range(rnd.randrange(1, 9))) for _ in range(6)) for _ in range(40)]
    phrases = [[tuple(p.split()) for p in t.split(", ")] for t in docs]
    grams = lambda p: [(k, p[k : k + 5]) for k in range(len(p) - 4)] if len(p) >= 5 else [(0, p)]
    on = {}
    for k, ps in enumerate(phrases):
        for p in ps:
            for _, g in grams(p):
                on.setdefault(g, set()).add(k % 7)
    df = spark.createDataFrame([(k, t, f"h{k % 7}") for k, t in enumerate(docs)], "doc_id bigint, text string, source string")
    got = {r.doc_id: r for r in spam.spam_evidence(df).collect()}
    sure = 0
    for k, ps in enumerate(phrases):
        want = sum(3 * len({i + j for i, g in grams(p) if len(on[g]) >= 3 for j in range(len(g))}) for p in ps)
        if got[k].listed == 0:
            sure += 1
            assert got[k].replicated == want
        assert got[k].replicated <= want
    assert sure


def test_stitched_pages_are_flagged_by_their_hosts_alone(spark):
    rnd = random.Random(8)
    stock = [" ".join(rnd.sample(WORDS, rnd.randrange(3, 8))) for _ in range(16)]
    stitched = [". ".join(rnd.sample(stock, 9)) for _ in range(12)]
    single = [" ".join(rnd.sample(WORDS, 6)) for _ in range(12)]
    mk = lambda hosts: spark.createDataFrame([(k, t, f"h{k % hosts}") for k, t in enumerate(stitched + single)], "doc_id bigint, text string, source string")
    assert {r.doc_id for r in spam.spam_pages(mk(7)).collect()} == set(range(12))
    assert spam.spam_pages(mk(1)).count() == 0  # the same phrases on one host
