"""Problem 4 on given values, on repeated responses, and edge cases."""

import pytest

from mirthlake.llm import residue as R

NONE = lambda w: False
KNOWN = lambda w: w in {"use", "when", "the", "a", "cat", "is", "not", "for", "it", "avoid", "you"}
SLOT = lambda w: w in ("topic", "target")


@pytest.mark.parametrize(
    ("value", "kind"),
    [
        ("Use {{ item.name | default }} when it rains.", "placeholder"),
        ("Avoid %(tag_1)s if (your situation).", "placeholder"),
        ("Pick the &lt;target&gt; now", "placeholder"),
        ("Pick [topic] now", "placeholder"),
        ("____: «second_cue»", "placeholder"),
        ('Mail says "Dear {{first_name}}": use the cat when it is late.', None),
        ("The aunt mumbled in [sarcasm] tags by june: use the cat.", None),
        ('Send it when june stays "TBD" for the cat.', None),
        ("Cat: the hallway shows a 404 page and it is fine.", None),
        ("Use the cat when server errors ate the scooter.", None),
        ("Avoid when someone truly asks how to enable JavaScript for the memo.", None),
        ("n/a", "stub"),
        ("<p>???</p>", "stub"),
        ("TODO: write emotion", "stub"),
        ("to be filled in by reviewer", "stub"),
        ("bla bla bla bla", "filler"),
        ("Lorem ipsum", "filler"),
        ("dsggfskaddj twrwz", "filler"),
        ("Use the cat when .", "frame"),
        ("Here is the JSON you asked for: {\"message\": \"\"}", "generator"),
        ("As requested, write one sentence of at least ten words.", "generator"),
        ("HTTP/1.1 502 Bad Gateway", "message"),
        ("Use the cat when HTTP/1.1 502 Bad Gateway", "message"),
        ("Not for a cat where somebody got Accès refusé. Code 504", "message"),
        ("Avoid the cat when the 503 outage hurt real users.", None),
        ("Bitte aktivieren Sie JavaScript, um diese Seite zu nutzen.", "message"),
        ("Veuillez activer JavaScript pour afficher cette page.", "message"),
        ('{"status":404,"error":"NOT FOUND"}', "message"),
        ("TypeError: cannot read properties of undefined (reading 'x')", "message"),
        ("Use the cat when it is 100 % sure that 5 of 10 people laugh.", None),
        ("Not for a cat that is not for you.", None),
    ],
)
def test_values(value, kind):
    assert R.residue(value, NONE, SLOT, KNOWN) == kind


def rows(spark, values):
    return spark.createDataFrame(values, "id string, field_name string, value string, title string, address string")


def test_responses_and_edges(spark):
    good = [(f"g{i}", "m", f"Use Cat{i} when the dog is late for the party number {i} again", f"Cat{i}", f"https://h{i % 3}.test/cat{i}.gif") for i in range(60)]
    odd = [(f"o{i}", "m", f"Sivu ei vastaa juuri nyt koodi {i}", f"Dog{i}", f"https://h{i % 3}.test/dog{i}.gif") for i in range(4)]
    once = [("s", "m", "Sivulla lukee jotain aivan muuta", "Dog", "https://h.test/x")]
    edge = [("n", "m", None, None, None), (None, "m", "n/a", None, None), ("e", "m", "n/a", None, None), ("e", "m", "n/a", None, None), ("l", "m", "word and another thing " * 20_000, None, None), ("z", "m", "", "", "")]
    got = {(r["id"], r["kind"]) for r in R.template_residue(rows(spark, good + odd + once + edge)).collect()}
    assert got == {(f"o{i}", "response") for i in range(4)} | {("e", "stub"), ("z", "stub")}
    assert R.template_residue(rows(spark, [])).count() == 0


def test_filler_is_learned(spark):
    latin = "ameto dolorim parvel sitare quenti".split()
    lorem = [(f"l{i}", "m", "Lorem ipsum " + " ".join(latin[i % 3 :] + latin), "T", None) for i in range(6)]
    bare = [("b", "m", "Parvel sitare ameto quenti.", "T", None)]
    assert {r["id"] for r in R.template_residue(rows(spark, lorem + bare)).collect()} == {f"l{i}" for i in range(6)} | {"b"}


def test_responses_repeated_most(spark):
    verbs = "calls writes sings sleeps waits drives cooks jumps reads walks".split()
    good = [(f"g{i}", "m", f"Use Cat{'abcdefghij'[i % 10]} when the dog {verbs[i // 10]} and the party of the neighbour {verbs[(i + i // 10) % 10]} again", f"Cat{'abcdefghij'[i % 10]}", f"https://h{i % 3}.test/cat.gif") for i in range(100)]
    odd = [(f"o{i}", "m", f"Sivu ei vastaa juuri nyt koodi {i}" + (" odota hetki" if i % 2 else ""), f"Dog{i}", f"https://h{i % 3}.test/dog{i}.gif") for i in range(50)]
    got = {(r["id"], r["kind"]) for r in R.template_residue(rows(spark, good + odd)).collect()}
    assert got == {(f"o{i}", "response") for i in range(50)}


def test_one_matching_title_clears_no_response(spark):
    good = [(f"g{i}", "m", f"Use Cat{'abcdefgh'[i % 8]} when the dog is late for the party number {i} again", f"Cat{'abcdefgh'[i % 8]}", f"https://h{i % 3}.test/x{i}.gif") for i in range(60)]
    odd = [(f"o{i}", "m", f"Sivu ei vastaa juuri nyt koodi {i}", "Sivu" if i == 0 else f"Dog{i}", f"https://h{i % 3}.test/dog{i}.gif") for i in range(9)]
    own = [(f"w{i}", "m", f"Karhu nukkuu pitkään talvella {i}", "Karhu" if i < 6 else "Dog", f"https://h{i % 3}.test/y{i}.gif") for i in range(9)]
    got = {(r["id"], r["kind"]) for r in R.template_residue(rows(spark, good + odd + own)).collect()}
    assert got == {(f"o{i}", "response") for i in range(9)}


def test_responses_within_texts(spark):
    good = [(f"g{i}", "m", f"Use Cat{'abcdefgh'[i % 8]} when the dog is late for the party number {i} again", f"Cat{'abcdefgh'[i % 8]}", f"https://h{i % 3}.test/x{i}.gif") for i in range(60)]
    odd = [(f"o{i}", "m", f"Sivu ei vastaa juuri nyt koodi {i}", f"Dog{i}", f"https://h{i % 3}.test/dog{i}.gif") for i in range(4)]
    held = [("h", "m", "Use Cata when the dog is late for sivu ei vastaa juuri nyt, koodi 77", "Cata", None), ("q", "m", 'Use Cata when the dog reads "sivu ei vastaa juuri nyt koodi 5" again', "Cata", None), ("s", "m", "Use Cata when the dog asks about sivu ei vastaa juuri nyt koodi 5", "Cata", None)]
    got = {(r["id"], r["kind"], tuple(r["evidence"])) for r in R.template_residue(rows(spark, good + odd + held)).collect()}
    assert got == {(i, "response", ("response",)) for i in ("o0", "o1", "o2", "o3", "h")}


def test_all_evidence_is_reported(spark):
    good = [(f"g{i}", "m", f"Use Cat{'abcdefgh'[i % 8]} when the dog is late for the party number {i} again", f"Cat{'abcdefgh'[i % 8]}", f"https://h{i % 3}.test/x{i}.gif") for i in range(60)]
    odd = [(f"o{i}", "m", f"Seite nicht gefunden ({400 + i})", f"Dog{i}", f"https://h{i % 2}.test/y{i}.gif") for i in range(3)]
    assert {tuple(r["evidence"]) for r in R.template_residue(rows(spark, good + odd)).collect()} == {("message", "response")}
