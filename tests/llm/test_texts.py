"""Truncation, pair defects, reading levels, languages and leaks."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prefloom.llm import _words as W
from prefloom.llm import languages as L
from prefloom.llm import leakage as K
from prefloom.llm import pair_defects as D
from prefloom.llm import reading_level as R
from prefloom.llm import truncation as T

FULL = "The sluice was first tested in Morgo, where a barge lifts the narrow loom. Nobody expected that it would hold."


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (FULL, T.COMPLETE), (FULL + " 🙂", T.COMPLETE), (FULL + "\n", T.COMPLETE), (FULL + "\n- loom\n* barge", T.ASK_ITEM), (FULL + "\n- ", T.CUT),
        (FULL + "\n— Morgo", T.COMPLETE), (FULL + "\n```\nlevel = 3\n```", T.COMPLETE), (FULL + "\n```\nlevel = 3", T.CUT), (FULL + "\n\n    total = 2 + 3", T.COMPLETE),
        (FULL + "\n<value>3</value>", T.COMPLETE), (FULL + "\n<value>3</row>", T.COMPLETE), (FULL + "\n<value>3", T.CUT), (FULL + "\n<val", T.CUT), (f'"{FULL}"', T.COMPLETE),
        (FULL[:-9], T.ASK_BARE), (FULL[:-9] + "   ", T.ASK_BARE), (FULL[:-9] + "�", T.CUT), (FULL[:-9] + "…", T.ASK_ELLIPSIS), (FULL + " Cf.", T.CUT), (FULL + " It says \\u00", T.CUT),
        (FULL + "\nA:", T.COMPLETE), ("does the loom even work on a barge", T.ASK_WORD), (None, T.COMPLETE), ("", T.COMPLETE), (" \n", T.COMPLETE), ("n/a", T.COMPLETE), ("x" * 100_000, T.ASK_WORD),
        # marks left open behind a finished sentence
        ("He explained the plan (see the long appendix for more details.", T.ASK_OPEN), ('She said "we will never go back to that place.', T.ASK_OPEN), ("Elle dit «an open quote that never closes.", T.ASK_OPEN),
        ('It has {"a": [1, 2, 3.', T.ASK_OPEN), ("The note says „we go home.", T.ASK_OPEN), ("<div>\nThe loom holds.", T.ASK_OPEN), ("See <b>the loom.", T.CUT),
        # and marks that aren't
        ("Er sagt „wir gehen“ und geht.", T.COMPLETE), ("Er sagt »wir gehen« und geht.", T.COMPLETE), ("Too bad :( but it works.", T.COMPLETE), ('The pipe is 5" wide.', T.COMPLETE), ("<p>One.<br>Two.", T.COMPLETE),
        ('"One paragraph.\n\n"And the next."', T.COMPLETE), ("a) first b) second.", T.COMPLETE),
        # escapes and what only looks like one
        ("it rose by 50%", T.ASK_WORD), ("he works in R&D", T.ASK_WORD), ("she left AT&T", T.ASK_WORD), ("copy it to C:\\", T.ASK_WORD), ("copy it to C:\\loom\\", T.ASK_WORD), ("rock & roll", T.ASK_WORD),
        ("this is caf&eac", T.CUT), ("salt &am", T.CUT), ("salt &#82", T.CUT), ("loom%2", T.CUT), ("caf%C3%", T.CUT), ("caf%C3%A", T.CUT), ("it is w\\", T.CUT), ("caf\\u00e", T.CUT),
    ],
)
def test_verdicts(text, want):
    assert T.verdict(text)[0] == want


def test_stack():
    assert [m for m, _ in T.open_marks('He said "yes (and')[0]] == ['"', "("]
    assert T.open_marks("a (b) [c] «d» ```x``` <p>q</p>")[0] == []


def test_baselines_decide(spark):
    tail = "the barge was late again"
    rows = [(i, "a", f"does the loom {i} work and {tail}", FULL, f"{FULL} Number {i}. Well, we will see...") for i in range(40)]
    rows += [(100 + i, "b", "does the loom work and the barge was" if i else "", FULL[: 60 + i], f"{FULL} Number {i} and so the bar...") for i in range(2)]
    rows += [(200, None, "does the loom work and the bar", None, "n/a"), (None, "a", "cut wor", None, None)]
    df = spark.createDataFrame(rows, "sample_id long, source string, prompt string, chosen string, rejected string").withColumn("field", F.lit(1)).withColumn("word", F.lit(1))
    got = {(r.sample_id, r.field) for r in T.truncated_fields(df.union(df.limit(5))).collect()}
    assert got == {(i, f) for i in (100, 101) for f in ("chosen", "rejected")} | {(101, "prompt"), (200, "prompt")}
    report = {(r.source, r.field): r for r in T.truncation_report(df.where("sample_id is not null"), T.truncated_fields(df)).collect()}
    assert report[("b", "chosen")].share == 1.0 and report[("a", "chosen")].cut_texts == 0 and report[(None, "prompt")].cut_texts == 1
    assert T.truncated_fields(df.limit(0)).count() == 0


def test_habits_of_a_source(spark):
    """What one source always does is no cut there, and one elsewhere."""
    bare = lambda i: f"The loom {i} holds. The barge was late"
    open_ = lambda i: f'The loom {i} holds. She said "the barge was late.'
    rows = [(i, "bare", bare(i), FULL, FULL) for i in range(600)] + [(1000 + i, "open", FULL, open_(i), FULL) for i in range(60)]
    rows += [(2000 + i, "plain", FULL, f"{FULL} {i}.", FULL) for i in range(30)] + [(3000, "plain", bare(0), open_(0), "See (the loom."), (3001, None, bare(1), "Is it late now? Yes. It was late", open_(1))]
    rows += [(3002, "bare", f"The loom holds. The {'z' * 260}", FULL, FULL)] + [(4000 + i, "plain", f"The {'z' * 300} holds.", FULL, FULL) for i in range(25)]
    df = spark.createDataFrame(rows, "sample_id long, source string, prompt string, chosen string, rejected string")
    got = {(r.sample_id, r.field) for r in T.truncated_fields(df).collect()}
    assert got == {(3000, f) for f in ("prompt", "chosen", "rejected")} | {(3001, f) for f in ("prompt", "chosen", "rejected")} | {(3002, "prompt")}


def test_cuts_with_an_ellipsis_at_the_same_place(spark):
    """A fragment or part of a word that follows many texts is no closing phrase; at a source's limit even a phrase is cut."""
    own = lambda i: f"Number {i} was read in Morgo."
    rows = [(i, "a", f"{own(i)} The barge was late. So does the loom. {FULL}", f"{own(i)} The...", f"{own(i)} Well, we will see...") for i in range(30)]
    rows += [(100 + i, "a", f"{own(i)} So does th…", f"{own(i)} So does…", FULL) for i in range(12)]
    end = " Well, we will see..."
    rows += [(200 + i, "kiosk", FULL, FULL, f"{FULL} {own(i)} The barge was la"[:140].ljust(140, "x")) for i in range(5)]
    rows += [(300, "kiosk", FULL, FULL, f"{FULL} Number".ljust(140 - len(end) - 1, "x") + "." + end)]
    df = spark.createDataFrame(rows, "sample_id long, source string, prompt string, chosen string, rejected string")
    got = {(r.sample_id, r.field) for r in T.truncated_fields(df).collect()}
    want = {(i, "chosen") for i in range(30)} | {(100 + i, f) for i in range(12) for f in ("prompt", "chosen")} | {(200 + i, "rejected") for i in range(5)} | {(300, "rejected")}
    assert got == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=30), st.lists(st.integers(0, 3), max_size=30), st.integers(1, 4))
def test_suffix_automaton_matches_brute_force(a, b, run):
    mine, theirs = D.SuffixAutomaton(a).copied(b, run)
    inside = set()
    for i in range(len(b) - run + 1):
        if any(a[j : j + run] == b[i : i + run] for j in range(len(a) - run + 1)):
            inside |= set(range(i, i + run))
    assert mine == len(inside) and theirs <= len(a) and (theirs > 0) == (mine > 0)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("I am sorry, but I can't help with that.", True), ("sorry i am not able to answer this question please ask a qualified person instead hope this helps", True),
        ("Diese Frage kann ich nicht beantworten. Bitte wenden Sie sich an eine Fachperson.", True), ("К сожалению, мне нельзя обсуждать эту тему.", True),
        ("I am sorry to hear that the loom failed, but it can be repaired. " + FULL, False), (f'The clerk said "I can\'t help with that", yet there is a way. {FULL}', False),
        ("I cannot stress enough how narrow the loom is. " + FULL, False), (FULL, False), ("", False),
    ],
)
def test_refusals(text, want):
    assert D.is_refusal(text) == want


#: Refusals as people write them.  The automaton knew 46 of them before its classes were widened by looking at the others.
HELD_OUT = """I refuse to answer.
I decline.
No comment.
It would be inappropriate for me to reply.
This topic is off limits for me.
That is beyond what I am prepared to go into.
I'd rather not get into that.
I am not at liberty to say.
Sorry, that's something I won't be discussing.
I have nothing to say on this matter.
My guidelines prevent me from responding to this.
I'm afraid this is not something I can write.
Answering this is not possible for me.
I must respectfully decline to comment.
We are unable to share any information about this subject.
I don't think I should answer that.
I'm not the right one to advise you here, so I won't.
I will not be taking part in this discussion.
This is outside of my area, so I can't help.
I am not comfortable talking about this.
I won't provide guidance on this topic.
I can't offer an opinion about that, sorry.
I cannot in good conscience respond to this request.
As a language model, I'm not able to fulfil this request.
I shall refrain from answering.
Unfortunately I am not permitted to speak about it.
I would prefer not to answer this.
I'm going to pass on this one.
I do not wish to discuss this.
My instructions do not allow me to answer questions of this sort.
It is against our policy to give advice on this.
I can't say anything about this topic.
I have been asked not to talk about that subject.
That is not a question I can answer.
I never comment on such matters.
I apologise, but I can't engage with this.
We won't respond to this.
Please understand that I can't continue with this request.
This assistant is not designed to handle such requests.
I could not possibly comment.
Thank you for your understanding, but I won't be able to assist.
I'm sorry, I can't go there.
I am not willing to write this.
Let us change nothing here: I will not reply.
I don't feel it is right for me to weigh in.
You should ask somebody else, since I won't answer.
I will keep quiet about that.
Sorry, this question must be left unanswered by me.
I am barred from giving any statement.
I prefer to stay out of this discussion, sorry.
I choose not to respond.
Responding to that would be wrong for me.
There is nothing I can say here.
I am forbidden to touch this topic.""".split("\n")
#: Answers that contain a negation, a first person or a word about answering.
ANSWERS = """I do not have a boat, I have a sled and a red hat.
We can not go to the barn today because the cow is asleep by the door.
The bridge could not support the load, so the crew of Morgo moved the crane to the north bank before the frost.
No answer came from the mill until the miller wrote to the council about the wheel.
I would not write the whole list down; the baker keeps the flour dry and the salt near the oven.
My brother will not help the farmer carry the stone, so the horse pulls the cart.
The request must not exceed forty barrels, and the harbour office does not provide ropes.
I never go to the market without the basket, the scale and two brass weights.""".split("\n")


def test_refusals_held_out():
    assert len(HELD_OUT) >= 50
    missed = [t for t in HELD_OUT if not D.is_refusal(t)]
    assert len(missed) <= 0.1 * len(HELD_OUT), missed
    assert not [t for t in ANSWERS if D.is_refusal(t)]


@pytest.mark.parametrize(("prompt", "response", "want"), [("Stop", "stop stop stop now", True), ("Stop now", "Stop now.", True), ("Stop", "go on", False), ("", "stop", False)])
def test_copies_of_very_short_prompts(prompt, response, want):
    batch = pa.record_batch([pa.array([1]), pa.array([prompt]), pa.array([response])], ["id", "p", "r"])
    (out,) = D._inspect(iter([batch]), ("r",))
    assert (out["defect"].to_pylist() == ["copy"]) == want


def test_words_of_both_languages_speak_for_neither():
    """Portuguese has a, do and as in common with English."""
    english = "Compare the method with the barge that the crew kept as a spare and do not forget the harbour."
    portuguese = "Dizem no pátio que a bomba de Mornor ainda protege a janela, porque a forja é demasiado frágil. Durante a ceifa a telha também alcança a fonte do porto, e as casas só depois."
    batch = pa.record_batch([pa.array([1, 2]), pa.array([english, english]), pa.array([portuguese, english + " " + portuguese])], ["id", "p", "r"])
    (out,) = D._inspect(iter([batch]), ("r",))
    assert list(zip(out["id"].to_pylist(), out["defect"].to_pylist(), strict=True)) == [(1, "language")]


@pytest.mark.parametrize("text", ["I am sorry, but I can't help with that." + " \n" * 1000, "I am sorry, but I can't help with that. " * 60])
def test_long_refusals(text):
    assert len(text) > 1500 and D.is_refusal(text) and not D.is_refusal(text + FULL * 20)


@pytest.mark.parametrize("text", [None, "", " \t\n", "​", "n/a", "N/A", "null", "None", "{}", "-", "...", '""', "<p></p>", "[no response]", "."])
def test_empty(text):
    assert T.is_empty(text)


def test_defects(spark):
    prompt = "What should the crew of the harbour check first if the narrow loom obstructs the barge during the spring and the wagon turns?"
    german = "Die Leute wissen, dass die Brücke nach dem langen Winter nicht mehr schmal ist und das Dach verändert. Das Boot ist auf dem Hof und nicht in der Nähe."
    rows = [
        (1, prompt, FULL, "n/a"), (2, prompt, f"Q: {prompt.upper()}\nA:", german), (3, prompt + " Answer in German, please.", german, None),
        (4, prompt, f'You ask: "{prompt}" Here is what is known. ' + FULL * 2, "I must decline this request."), (5, None, None, FULL), (6, prompt, FULL[:-9], prompt),
    ]
    df = spark.createDataFrame(rows, "sample_id long, prompt string, chosen string, rejected string").withColumn("source", F.lit("s")).withColumn("defect", F.lit(0))
    got = {(r.sample_id, r.field, r.defect) for r in D.pair_defects(df.union(df)).collect()}
    assert got == {(1, "rejected", "empty"), (2, "chosen", "copy"), (2, "rejected", "language"), (3, "rejected", "empty"), (4, "rejected", "refusal"), (5, "chosen", "empty"), (6, "chosen", "truncated"), (6, "rejected", "copy")}
    assert D.pair_defects(df.limit(0)).count() == 0


CHILD = "We can see the dog by the pond today. The cat is not tall, it is tiny! Oh no, the hat fell into the cup."
SCHOOL = "The engine was first tested in town, where a merchant supports the narrow harbour because the method is more reliable. Locals expected otherwise."
EXPERT = "Notwithstanding residual confounding, the covariance renormalises the axiomatic admittance. Hence isothermal advection obtains within the formalism."


def model():
    rng = random.Random(0)
    texts, levels = [], []
    for level, base in (("child", CHILD), ("school", SCHOOL), ("expert", EXPERT)):
        for _ in range(20):
            parts = base.split(". ")
            rng.shuffle(parts)
            texts.append(". ".join(parts))
            levels.append(level)
    return R.fit([*texts, None, "x"], [*levels, "child", "unknown"])


def test_levels():
    m = model()
    level, share = R.predict(m, W.words([CHILD, SCHOOL, EXPERT, f"{CHILD} {CHILD} {SCHOOL}", "", "zzz qqq", (CHILD + " ") * 2000]))
    assert [R.LEVELS[i] if i >= 0 else None for i in level] == ["child", "school", "expert", "child", None, None, "child"]
    assert share[0] == 1 and share[3] < 1
    assert R.predict(R.fit([], []), W.words(["a b"]))[0].tolist() == [-1]


@pytest.mark.parametrize(
    ("preference", "want"),
    [
        ("Keep it simple enough for kindergarten.", "child"), ("The reader is seven and easily lost.", "child"), ("Use words a 9-year-old knows", "child"), ("for third-grade readers", "child"),
        ("Pitch it at a teenager of about fourteen.", "school"), ("Explain it to an interested adult without special training.", "school"), ("a ninth-grade textbook", "school"), ("for the 5th grade", "school"),
        ("Write for specialists.", "expert"), ("Assume a doctorate.", "expert"), ("Be brief.", None), (None, None), ("", None),
    ],
)
def test_asked_levels(preference, want):
    assert R.asked_level(preference) == want


def test_unsuited(spark):
    m = model()
    samples = spark.createDataFrame([(1, 0, "Tell me of the dog, the hat and the pond in the town.", EXPERT), (2, 0, "p", CHILD), (3, 1, "p", CHILD), (4, 2, "p", CHILD), (5, 0, "p", None), (6, 0, None, "I must decline this request.")], "sample_id long, dataset_idx int, prompt string, chosen string").withColumn("share", F.lit(1))
    tasks = spark.createDataFrame([(0, "for small children"), (1, "for experts"), (2, "Be brief.")], "dataset_idx int, preference string")
    examples = spark.createDataFrame([(i, t, v) for i, (t, v) in enumerate([(CHILD, "child"), (SCHOOL, "school"), (EXPERT, "expert"), (None, "child")] * 8)], "example_id long, text string, reading_level string")
    assert {(r.sample_id, r.reading_level) for r in R.unsuited_levels(samples.union(samples), tasks, examples).collect()} == {(1, "expert"), (3, "child")}
    assert R.unsuited_levels(samples.limit(0), tasks, examples).count() == 0
    assert R.reading_levels(samples, m, "sample_id", "chosen").count() == 6


def test_held_out_levels(sf_dir, spark):
    rows = spark.read.parquet(f"{sf_dir}/level_examples.parquet").orderBy("example_id").collect()
    hit = 0
    for fold in range(5):
        train, test = [r for i, r in enumerate(rows) if i % 5 != fold], rows[fold::5]
        level, _ = R.predict(R.fit([r.text for r in train], [r.reading_level for r in train]), W.words([r.text for r in test]))
        hit += sum(R.LEVELS[k] == r.reading_level for k, r in zip(level, test, strict=True))
    assert hit >= 0.95 * len(rows)


@pytest.mark.parametrize(("label", "want"), [("en-GB", "en"), ("DE", "de"), ("por", "pt"), ("Portuguese", "pt"), ("de_AT", "de"), ("xx", None), ("bg", None), ("und", None), ("", None), (None, None), ("??", None)])
def test_labels(label, want):
    assert L.label_language(label) == want


def language_docs(sf_dir, spark):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    return rows, L.fit([r.text for r in rows], [r.lang for r in rows])


def test_languages(sf_dir, spark):
    rows, m = language_docs(sf_dir, spark)
    de = "Man sagt, die Brücke sei schmal, doch das Boot erreicht fast immer das Ufer nach dem langen Winter."
    en = "The main difference is that the passage protects the boat, while the discovery stays hollow during the spring."
    ru = "Говорят, у жителей деревни забор очень старый, но источник почти всегда портит компас во время жатвы."
    texts = [de, f"{en} {de}", f"{ru}\n{en}\n{ru}", f'{en} They call it "die Mauer" there.', "", None, "Hello", en.replace(".", "") + " " + de.replace(",", "").lower(), en * 200]
    parts = L.document_parts(m, W.words(texts))
    assert [[L.LANGS[p[2]] for p in x] for x in parts] == [["de"], ["en", "de"], ["ru", "en", "ru"], ["en"], [], [], [parts[6] and L.LANGS[parts[6][0][2]]], ["en", "de"], ["en"]]
    for x, w in zip(parts, W.words(texts).counts, strict=True):
        assert not x or (x[0][0] == 0 and x[-1][1] == w and all(a[1] == b[0] for a, b in zip(x, x[1:], strict=False)))
        assert all(0 < p[3] <= 1 for p in x)
    df = spark.createDataFrame([(i, "en", t) for i, t in enumerate(texts)] + [(None, None, de)], "doc_id long, lang string, text string").withColumn("parts", F.lit(9))
    found = L.mislabelled(L.document_languages(df, model=m)).collect()
    assert {r.doc_id for r in found} == {None, 0, 1, 2, 7} | ({6} if parts[6][0][2] else set())
    assert L.document_languages(df.limit(0)).count() == 0


def test_items():
    assert K.split_item("Read the passage, then answer.\nA passage here.\nWhat is it?") == ("A passage here.", "What is it?")
    assert K.split_item("A passage.\nWhat?") == ("A passage.", "What?")
    assert K.split_item(None) == ("", "") and K.split_item("One") == ("One", "")


def leak_data():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(900)]
    make = lambda n: [rng.choice(vocab) for _ in range(n)]
    passages = [make(60) for _ in range(30)]
    items = [(i, " ".join(passages[i // 2]) + ".\n" + " ".join(make(30)) + "?") for i in range(60)]
    docs, want = [], set()
    for d in range(200):
        body = [f"b{rng.randrange(900)}" for _ in range(rng.randrange(30, 150))]
        kind, p = d % 5, rng.randrange(30)
        unit = passages[p]
        at = rng.randrange(len(body))
        if kind == 0:  # a run of 24 with three changes
            run = unit[10:34]
            for k in (3, 11, 19):
                run[k] = "changed"
        elif kind == 1:  # the same with missing words
            run = [x for k, x in enumerate(unit[5:45]) if k not in (4, 12, 20, 28, 36)]
        elif kind == 2:  # too short
            run = unit[10:30]
        elif kind == 3:  # too many changes
            run = [x if k % 4 else "changed" for k, x in enumerate(unit)]
        else:
            run = []
        docs.append((d, " ".join(body[:at] + [x.upper() + "," for x in run] + body[at:])))
        if kind in (0, 1):
            want |= {(d, 2 * p), (d, 2 * p + 1)}
    return items, docs, want


def test_leaks(spark):
    items, docs, want = leak_data()
    t = spark.createDataFrame([*items, (99, None)], "item_id long, text string").withColumn("suite", F.lit("s"))
    d = spark.createDataFrame([*docs, (1000, None), (1001, ""), (None, items[0][1])], "doc_id long, text string").withColumn("item_id", F.lit(0))
    out = K.leaked_items(d.union(d.limit(50)), t)
    assert {(r.doc_id, r.item_id) for r in out.collect()} == want
    assert K.leak_report(out, t).where("documents > 0").count() == len({i for _, i in want})
    assert all(r.run == max(r.passage_run, r.question_run) >= K.RUN for r in out.collect())
    many = K.leaked_items(d, t, shard_bytes=2000)  # an index of many shards
    assert {(r.doc_id, r.item_id) for r in many.collect()} == want
    assert K.leaked_items(d.limit(0), t).count() == 0 and K.leaked_items(d, t.limit(0)).count() == 0


def test_block_maxima_miss_nothing():
    """Every window above a unit's threshold is retrieved, as by scoring all units."""
    items, docs, _ = leak_data()
    shard = K.build_index(items)
    term = np.repeat(shard.block_key // len(shard.block_least), np.diff(shard.block_first))
    weights = np.zeros((len(shard.terms), len(shard.least)))
    weights[term, shard.unit] = shard.weight
    assert (np.diff(shard.unit)[np.diff(term) == 0] > 0).all() and (shard.greatest[:-1] == weights.max(axis=1)).all()
    w = W.words([t for _, t in docs])
    got = {(t, u, s) for t, u, _, s, _ in K._retrieve(shard, w)}
    place = {int(t): i for i, t in enumerate(shard.terms)}
    for text in range(0, len(docs), 7):
        a, b = int(w.first[text]), int(w.first[text + 1])
        for s in range(a, max(a + 1, b - K.WINDOW + K.STRIDE), K.STRIDE):
            q = {place[h] for h in w.hashes[s : min(b, s + K.WINDOW)].tolist() if h in place}
            score = weights[sorted(q)].sum(axis=0) if q else np.zeros(len(shard.least))
            grams = set(K._grams(w.hashes[s : min(b, s + K.WINDOW)], K.PIECE).tolist())
            for u in np.flatnonzero(score >= shard.least):
                assert ((text, int(u), s) in got) == (not shard.unit_pieces[u].isdisjoint(grams))
