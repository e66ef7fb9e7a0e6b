import random

from veilspark.llm import substring_dedup as D


def brute(rows):
    order = sorted({(i is None, i if i is not None else 0, t or "") for i, t, _ in rows})
    first, cuts = set(), {}
    for doc in order:
        units = [" ".join(u.split()) for u in D.units(doc[2])]
        gone = set()
        for p in range(len(units) - D.RUN + 1):
            span = tuple(units[p : p + D.RUN])
            if sum(len(u.split()) for u in span) >= D.LEAST_WORDS:
                if span in first:
                    gone |= set(range(p, p + D.RUN))
                first.add(span)
        cuts[doc] = gone
    out = []
    for i, t, _ in rows:
        gone = cuts[i is None, i if i is not None else 0, t or ""]
        units = list(D.units(t or ""))
        out.append((i, len(units), len(gone), "".join(u for k, u in enumerate(units) if k not in gone)))
    return sorted(out, key=repr)


def sentence(rng):
    return " ".join(rng.choice("abcdefghijklmnop") * rng.randrange(1, 6) for _ in range(rng.randrange(3, 40))).capitalize() + rng.choice([". ", "! ", "?\n", ".\n\n", ", "])


def test_equals_brute_force(docs, rows_of):
    rng = random.Random(17)
    passages = ["".join(sentence(rng) for _ in range(6)) for _ in range(4)]
    rows = []
    for i in range(120):
        parts = [sentence(rng) for _ in range(rng.randrange(12))] + rng.sample(passages, rng.randrange(3))
        rng.shuffle(parts)
        rows.append((i, "".join(parts), "s"))
    rows += [(500, None, "s"), (501, "", "s"), (502, "One. Two. Three.", "s"), (503, "One. Two. Three.", "s"), (None, passages[0], None), (7, rows[7][1], "s"), (504, "same words here again. " * 3000, "s")]
    got = D.dedup_spans(docs(*rows)).select("doc_id", "n_sentences", "n_removed", "text")
    assert rows_of(got) == brute(rows)


def test_long_passages_repeat_whatever_surrounds_them(docs):
    rng = random.Random(18)
    passage = " ".join(f"p{rng.randrange(10_000)}" + (", " if k % 9 == 8 else "") for k in range(70)) + "."
    got = D.dedup_spans(docs((1, passage, "s"), (2, "Begin words. " + passage, "s"), (3, "lead in without stop " + passage + " tail", "s"))).orderBy("doc_id").collect()
    assert got[0].n_removed == 0
    assert "Begin words. " in got[1].text and len(got[1].text.split()) <= 5
    assert len(got[2].text.split()) < 40


def test_units_join_to_the_text_and_empty_table(docs):
    for text in ["", " ", "\n\n", "...", " a, b; c. d\n", "x " * 1000, ",,," * 50, "w" * 100_000]:
        assert "".join(D.units(text)) == text
    assert D.dedup_spans(docs()).count() == 0


def test_cuts_do_not_depend_on_the_lead_in(docs):
    rng = random.Random(19)
    words = lambda n: [f"q{rng.randrange(10_000)}" for _ in range(n)]
    shared = lambda a, b: set(zip(*(x.tolist() for x in D.spans(a)[2:]))) & set(zip(*(x.tolist() for x in D.spans(b)[2:])))
    for length in range(51, 61):
        body = words(length)
        middle = length // 2
        for passage in (" ".join(body), " ".join(body[:middle]) + ". " + " ".join(body[middle:])):
            for lead in range(41):
                assert shared(passage, " ".join(words(lead) + [passage, *words(5)])), (length, lead)
    body = " ".join(words(60))
    rows = [(lead, " ".join(words(lead) + [body]), "s") for lead in range(20)]
    got = {r.doc_id: r.n_removed for r in D.dedup_spans(docs(*rows)).collect()}
    assert got[0] == 0 and all(got[lead] >= D.RUN for lead in range(1, 20))


def test_periodic_text_is_cut_at_a_maximum_length():
    for period in (["x"], ["x", "y"], ["x", "y", "z"], ["a", "b", "a", "c"]):
        text = "  " + " ".join(period * 500)
        parts = list(D.units(text))
        assert "".join(parts) == text and all(len(p.split()) <= D.MOST for p in parts)
