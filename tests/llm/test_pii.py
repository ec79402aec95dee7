import random
import re


from cohortlens.llm import pii as P

#: The contract's patterns (fixed values).
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def plain_spans(text):
    out = []
    for kind, form in PLAIN.items():
        for m in re.finditer(form, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if {"email": True, "ip": kind == "ip" and all(int(p) < 256 for p in m.group().split(".")),
                    "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def spans(rows, name="base"):
    return [[tuple(s) for s in r[name]] for r in rows]


def test_base_spans_of_random_texts(docs):
    rng = random.Random(3)
    parts = [*"a@@..--+%_ ()😀é\n", "12", "255", "256.", "1.2.3.4", "a@b.c", "+1 (012) 345-6789", "4111 1111 1111 1111", "4111-1111", "9807915762804490", "00000000012", "x", "7"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(600)]
    got = P.find(docs(*enumerate(texts))).orderBy("doc_id").collect()
    assert spans(got) == [plain_spans(t) for t in texts] and sum(map(len, spans(got))) > 300


def test_very_long_runs_take_no_stack(docs):
    texts = ["7" * 100_000, "1 2" * 50_000, "a@b" + ".c" * 50_000, "x." * 50_000, "+1" + "(" * 100_000, "@" * 20_000]
    got = P.find(docs(*enumerate(texts))).orderBy("doc_id").collect()
    assert spans(got) == [plain_spans(t) for t in texts]


def test_patterns_of_the_seeds_discover_unseen_identifiers(docs):
    seeds = [(k, f"please write to me{k}@mail.example today") for k in range(12)]
    hidden = (50, "please write to bob#42 today")
    other = [(100 + k, f"see page {k} of chapter b{k} now") for k in range(12)]
    got = {r.doc_id: r for r in P.find(docs(*seeds, hidden, *other)).collect()}
    at = hidden[1].index("bob")
    assert got[50].base == [] and spans([got[50]], "spans") == [[("email", at, at + 6)]]
    assert all(got[k].spans == [] for k, _ in other) and all(got[k].spans == got[k].base != [] for k, _ in seeds)


def test_a_pattern_that_is_often_wrong_discovers_nothing(docs):
    rows = [(k, f"write to me{k}@mail.example") for k in range(6)] + [(20 + k, f"write to b{k}") for k in range(6)]
    assert all(r.spans == r.base for r in P.find(docs(*rows)).collect())


def test_redaction_keeps_the_rest(docs):
    rows = docs((1, "x a@b.cd, 1.2.3.4 y"), (2, "none"), (3, None), (None, "card 4111 1111 1111 1111 z"), (3, "😀 a@b.cd"))
    out = P.redact(rows)
    assert out.columns == rows.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in out.collect()) == [
        (0, "card [CARD] z"), (1, "x [EMAIL], [IP] y"), (2, "none"), (3, ""), (3, "😀 [EMAIL]")]


def test_messy_rows(messy):
    rows = P.find(messy).collect()
    assert len(rows) == messy.count() and all(r.base == [] and r.spans == [] for r in rows)
    assert P.redact(messy).select("doc_id", "text").exceptAll(messy.select("doc_id", "text")).count() == 0
    assert P.find(messy.limit(0)).count() == 0 and P.redact(messy.limit(0)).count() == 0


def test_main_path_has_no_python(messy):
    plan = P.find(messy)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
