"""Problem 8 on given sentences, learned names, replacement and edge cases."""

import pytest

from mirthlake.llm import personal as P

def lexicon(families=(), ordinary=(), places=()):
    w, parts, places_ = P.tables()
    for f in families:
        w[0, P.cells(f)] += 5
        w[2, P.cells(f)] += 5
        for e in P.ends(f):
            parts[0, P.cells(e)] += 1
    for o in ordinary:
        w[0, P.cells(o)] += 900
        w[1, P.cells(o)] += 800
        for e in P.ends(o):
            parts[1, P.cells(e)] += 1
    for p in places:
        places_[0, P.cells(p)] += 3
    for lead, sure in (("ticket", 0), ("order", 0), ("call", 900)):
        places_[1, P.cells("~" + lead)] += sure
        places_[2, P.cells("~" + lead)] += 900
    return P.Lexicon(w, parts, places_)


FIND = P.Finder(lexicon(["velowick", "drenquist", "toribeck", "halastrom", "quilorosa"], "the of and please thank for fix frame stolen who wrote says upload came from last week street call order ticket".split(), ["hobb st", "@port hesper"]))


def found(text, kind):
    return [text[a:b] for a, b, k in FIND.mentions(text) if k == kind]


@pytest.mark.parametrize(
    ("text", "kind", "want"),
    [
        ("Please thank Dr. Velowick for the fix", "person_name", ["Velowick"]),
        ("According to Halastrom, Colin the frame", "person_name", ["Halastrom, Colin"]),
        ("from TORIBECK Leroy last week", "person_name", ["TORIBECK Leroy"]),
        ("Hi Priya O'Toribeck,", "person_name", ["Priya O'Toribeck"]),
        ("Kofi de la Quilorosa wrote", "person_name", ["Kofi de la Quilorosa"]),
        ("T. Drenquist's frame", "person_name", ["T. Drenquist"]),
        ("Marcus van Drenquist", "person_name", ["Marcus van Drenquist"]),
        ("Das Bild stammt von VELOWICK Torben.", "person_name", ["VELOWICK Torben"]),
        ("de la Quilorosa, Jörg", "person_name", ["de la Quilorosa, Jörg"]),
        ("Lucía D. Velowick", "person_name", ["Lucía D. Velowick"]),
        ("jörg drenquist hat den Text", "person_name", ["jörg drenquist"]),
        ("Amélie Velowick", "person_name", ["Amélie Velowick"]),
        ("Use Grand Trolley Wink when it rains", "person_name", []),
        ("write to a.b+c@mail.bücher.example, please", "email", ["a.b+c@mail.bücher.example"]),
        ("mailto:x_y@host.test;", "email", ["x_y@host.test"]),
        ("p (at) uni (dot) host (dot) test. Das", "email", ["p (at) uni (dot) host (dot) test"]),
        ("colin+x AT uni DOT host DOT test", "email", ["colin+x AT uni DOT host DOT test"]),
        ("sheet@2x.png and signals@9.3.0 and me@work and @fan", "email", []),
        ("call +44 7700 900004 now", "phone", ["+44 7700 900004"]),
        ("Fax: (303) 555-0103", "phone", ["(303) 555-0103"]),
        ("\n020 7946 0247\n", "phone", ["020 7946 0247"]),
        ("Meine Nummer 030/23125-476 steht", "phone", ["030/23125-476"]),
        ("au +33 (0)6 39 98 20 05 ce soir", "phone", ["+33 (0)6 39 98 20 05"]),
        ("617‑555‑0115", "phone", ["617‑555‑0115"]),
        ("Ticket 1830-232-25 is closed, frame 00:13:48", "phone", []),
        ("SSN 941-11-0968 and QQ 49 99 23 C", "id_number", ["941-11-0968", "QQ 49 99 23 C"]),
        ("Steuer-ID 00 644 198 218;", "id_number", ["00 644 198 218"]),
        ("Se lee mi DNI 00.002.206-Q en la foto", "id_number", ["00.002.206-Q"]),
        ("Order GX7064493 is about posters", "id_number", []),
        ("at Flat 5, 100 Hobb St, Port Hesper and", "street_address", ["Flat 5, 100 Hobb St, Port Hesper"]),
        ("I LIVE AT 7B HOBB ST, PORT HESPER AND WANT", "street_address", ["7B HOBB ST, PORT HESPER"]),
        ("Hafenstr. 116\n00783 Niederfalk!", "street_address", ["Hafenstr. 116\n00783 Niederfalk"]),
        ("Vivo en C/ Molino Viejo, 97, 9.º B y sale", "street_address", ["C/ Molino Viejo, 97, 9.º B"]),
        ("40 bis avenue du Vieux Four, 00285 Saint-Cloriac", "street_address", ["40 bis avenue du Vieux Four, 00285 Saint-Cloriac"]),
        ("Top 44 Avenue memes, rank 627", "street_address", []),
    ],
)
def test_mentions(text, kind, want):
    assert found(text, kind) == want


def test_learns_names_and_replaces(spark):
    families = [f"{a}{b}" for a in ("Quil", "Dren", "Thol", "Vel", "Osta") for b in ("rosa", "wick", "quist", "strom", "beck")]
    given = ["Colin", "Priya", "Zorblex", "Nadia"]
    rows = [(i, f"We asked {given[i % 4]} {families[(i * 7) % 25]} about the lobster. The lobster was fine.") for i in range(60)]
    rows += [(100 + i, f"Thanks to Mrs. {f} for the lobster.") for i, f in enumerate(families)]
    rows += [(900, None), (901, ""), (902, "priya zorquist asked"), (None, "x@y.test")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, kind int")
    got = {(r["doc_id"], r["found_text"]) for r in P.personal_mentions(df).collect() if r["kind"] == "person_name"}
    want = {(i, f"{given[i % 4]} {families[(i * 7) % 25]}") for i in range(60)} | {(100 + i, f) for i, f in enumerate(families)} | {(902, "priya zorquist")}
    assert got == want
    clean = {r["doc_id"]: (r["text"], r["n_replaced"]) for r in P.sanitised(df).where("doc_id is not null").collect()}
    assert clean[0][0] == "We asked [PERSON_NAME] about the lobster. The lobster was fine." and clean[900] == (None, 0) and clean[901] == ("", 0)
    assert clean[100] == ("Thanks to Mrs. [PERSON_NAME] for the lobster.", 1)


def test_edges(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert P.personal_mentions(df).count() == 0 and P.sanitised(df).count() == 0
    long = "nothing to see here. " * 20_000 + "Mail a@b.test"
    df = spark.createDataFrame([(1, long), (1, long), (2, "a@b.test a@b.test")], "doc_id bigint, text string")
    assert sorted(tuple(r) for r in P.personal_mentions(df).collect()) == [(1, "email", "a@b.test"), (2, "email", "a@b.test")]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Please thank Velowick, J. for the fix", ["Velowick, J"]),
        ("Please thank DRENQUIST J. R. for the fix", ["DRENQUIST J. R"]),
        ("The frame came from van Halastrom, J.", ["van Halastrom, J"]),
        ("Velowick, J. Drenquist wrote last week", ["J. Drenquist"]),
        ("The order, J. and the Ticket B. came last week", []),
    ],
)
def test_initial_after_family_name(text, want):
    assert found(text, "person_name") == want


def test_the_threshold_decides(monkeypatch):
    text = "Please thank Dr. Velowick and Colin Drenquist and T. Halastrom, a@b.test, SSN 941-11-0968, call 020 7946 0247, 7B Hobb St, Port Hesper"
    find = P.Finder(lexicon(["velowick", "drenquist", "halastrom"], ["please", "thank"], ["hobb st"]))
    assert len(find.mentions(text)) == 7
    monkeypatch.setattr(P, "DISCLOSURE", 1e9)
    assert P.Finder(lexicon(["velowick", "drenquist", "halastrom"], ["please", "thank"], ["hobb st"])).mentions(text) == []


def test_names_are_learned_without_seeds(spark):
    families = [f"{a}{b}" for a in ("Quil", "Dren", "Thol", "Vel", "Osta") for b in ("rosa", "wick", "quist", "strom", "beck")]
    given = ["Zorblex", "Mirtane", "Pholdo", "Quenna"]
    rows = [(i, f"We asked {given[i % 4]} {families[(i * 7) % 25]} about the lobster. The lobster was fine.") for i in range(60)]
    rows += [(100 + i, f"Thanks to Mrs. {f} for the lobster. Mail to {given[i % 4].lower()}.{f.lower()}@host.test about it.") for i, f in enumerate(families)]
    got = {(r["doc_id"], r["found_text"]) for r in P.personal_mentions(spark.createDataFrame(rows, "doc_id bigint, text string")).collect() if r["kind"] == "person_name"}
    assert {(i, f"{given[i % 4]} {families[(i * 7) % 25]}") for i in range(60)} | {(100 + i, f) for i, f in enumerate(families)} == got
