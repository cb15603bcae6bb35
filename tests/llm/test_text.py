"""Encoding, splitting and leak search against plain implementations."""

import base64
import os
import quopri
import random

import numpy as np
import pytest

pytest.importorskip("rainweft.llm")
from rainweft.llm import encoding, leakage, mailtext, splitting

pytestmark = pytest.mark.skipif(not os.path.exists(f"{encoding.TOKENIZER_DIR}/{encoding.VOCABULARY}.tiktoken"), reason="no vocabulary")

DOCS = "doc_id bigint, text string, ids string, item_id string, kind string"


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{encoding.TOKENIZER_DIR}/{encoding.VOCABULARY}.json")
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


ALPHABET = [" ", "\n", "\t", "\r\n", " ", "　", "abc", "XYZ", "0", "19", ".", ",", "'s", "'ll", "<|endoftext|>", "é", "ß", "日本", "\x1c", "\U0001f600", "===", "QmFzZTY0"]


@pytest.mark.parametrize("chunk", [4, 64, 1024])
def test_chunks_joined_exactly(plain, chunk):
    own = encoding.ChunkEncoder(chunk_bytes=chunk, cache_bytes=2000)
    rng = random.Random(chunk)
    for _ in range(300):
        s = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 400)))
        assert own.encode(s).tolist() == plain(s)


def test_shared_chunks_are_cached():
    own = encoding.ChunkEncoder(chunk_bytes=64)
    tail = "".join(f"sentence number {k} is the same in both mails. " for k in range(200))
    own.encode("first mail begins here. " + tail)
    before = len(own._young)
    own.encode("quite another beginning, much longer than that. " + tail)
    assert len(own._young) - before < before / 4


def test_corpus_encoding(spark, plain):
    long = "no break" * 5 + "x" * 20000 + " é" * 5000
    rows = [(1, "Hi <|endoftext|> there", "c", "c", "c"), (2, "", "c", "c", "c"), (3, None, None, None, None), (None, "a b", "c", "c", "c"), (4, long, "c", "c", "c"), (5, "x", "c", "c", "c"), (5, "x", "c", "c", "c")]
    got = encoding.encode_corpus(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    assert len(got) == 7
    by = {r.doc_id: r.ids for r in got}
    assert by[2] == [] and by[3] == [] and by[1] == plain(rows[0][1]) and by[4] == plain(long) and by[None] == plain("a b")
    assert encoding.encode_corpus(spark.createDataFrame([], DOCS)).count() == 0


def test_range_maximum_takes_the_rightmost():
    rng = np.random.RandomState(1)
    v = rng.randint(0, 4, 57)
    table = splitting.RangeMax(v)
    for _ in range(300):
        a, b = sorted(rng.randint(0, 57, 2))
        best = v[a : b + 1].max()
        assert table.best(a, b) == max(i for i in range(a, b + 1) if v[i] == best)


def test_pieces_cover_and_overlap(spark, plain):
    rng = random.Random(3)
    para = lambda: " ".join(rng.choice(["rain", "radar", "the", "gauge", "stopped"]) for _ in range(rng.randint(20, 90))) + ".\n\n"
    long, short, solid = "".join(para() for _ in range(90)), "short text", "9" * 9000
    rows = [(1, long, "c", "c", "c"), (2, short, "c", "c", "c"), (3, None, "c", "c", "c"), (4, "", "c", "c", "c"), (5, solid, "c", "c", "c")]
    df = spark.createDataFrame(rows, DOCS)
    got = splitting.split_documents(df).orderBy("doc_id", "piece_no").collect()
    assert {r.doc_id for r in got} == {r[0] for r in rows if r[1] and len(plain(r[1])) > 2048}
    for doc, text in ((1, long), (5, solid)):
        pieces, ids = [r for r in got if r.doc_id == doc], plain(text)
        if len(ids) <= 2048:
            assert not pieces
            continue
        back = list(pieces[0].ids)
        for a, b in zip(pieces, pieces[1:]):
            assert b.ids[:128] == a.ids[-128:] and b.piece_no == a.piece_no + 1
            back += b.ids[128:]
        assert back == ids and all(len(p.ids) <= 2048 for p in pieces) and pieces[-1].cut_kind is None
    assert all(r.cut_kind == splitting.PARAGRAPH for r in got if r.doc_id == 1 and r.cut_kind is not None)
    whole = splitting.split_documents(df, whole=True).where("doc_id = 2").first()
    assert whole.ids == plain(short) and whole.n_pieces == 1
    assert splitting.split_documents(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        splitting.split_documents(df, limit=100, overlap=60)


def test_cuts_of_text_without_blanks(spark):
    rng = random.Random(5)
    signs = [chr(k) for k in range(0x4E00, 0x4F00)]
    sentences = "".join("".join(rng.choice(signs) for _ in range(rng.randint(20, 60))) + "。" for _ in range(300))
    solid = "".join(rng.choice(signs) for _ in range(9000))
    got = splitting.split_documents(spark.createDataFrame([(1, sentences, "c", "c", "c"), (2, solid, "c", "c", "c")], DOCS)).orderBy("doc_id", "piece_no").collect()
    own = encoding.ChunkEncoder()
    for r in got:
        text = sentences if r.doc_id == 1 else solid
        data, lengths = text.encode(), own.length[np.array(own.encode(text))]
        if r.cut_kind is not None:
            head = data[: int(lengths[: r.token_end].sum())].decode()  # whole characters
            assert r.cut_kind == (splitting.SENTENCE if r.doc_id == 1 else 0) and (r.doc_id == 2 or head.endswith("。"))
    assert sum(r.cut_kind is not None for r in got) > 8


def test_mail_boundaries():
    mail = b"Subject: x\r\n\r\nHi.\r\n\r\n> quoted\r\n------=_Part_1_abc\r\nContent"
    at, kind = splitting.boundaries(mail)
    strongest = {int(a): int(k) for a, k in sorted(zip(at, kind), key=lambda p: p[1])}
    assert strongest[mail.index(b"Hi.")] == splitting.PARAGRAPH and strongest[mail.index(b"> quoted")] == splitting.QUOTE and strongest[mail.index(b"------=")] == splitting.PART


PASSAGE = "Historians of Quakry claim that every tunnel held 7664 copper beetles, although the bakery itself was auctioned slowly in 1203 by the guild."
ITEMS = "item_id bigint, passage string, text string, doc_id string"


def leaks(spark, docs, items=((1, PASSAGE), (2, PASSAGE), (3, "too short"), (4, None))):
    d = spark.createDataFrame([(k, t, "c", "c", "c") for k, t in docs], DOCS)
    i = spark.createDataFrame([(a, b, "c", "c") for a, b in items], ITEMS)
    return {(r.doc_id, r.item_id): r.kind for r in leakage.find_leaks(d, i).collect()}


def part(body, encoding_, kind="text/plain", charset="utf-8"):
    return f"From: a@b\nContent-Type: multipart/mixed; boundary=\"bb1\"\n\n--bb1\nContent-Type: {kind}; charset={charset}\nContent-Transfer-Encoding: {encoding_}\n\n{body}\n--bb1--\nfooter words\n"


def test_leaks_under_all_wrappings(spark):
    words = PASSAGE.split()
    html = "<html><body><style>p {x}</style>" + " ".join(f"<b>{w}</b>" if k % 3 else w for k, w in enumerate(words)) + "</body></html>"
    german = "Der Größte von Quakry zählte über 7664 Käfer, während die Bäckerei langsam versteigert wurde"
    docs = [
        (1, "before " + PASSAGE.upper().replace(",", " --") + " after"),
        (2, "> " + "\n> ".join(words)),
        (3, part(base64.encodebytes(PASSAGE.encode()).decode(), "base64")),
        (4, part(quopri.encodestring(PASSAGE.encode()).decode(), "quoted-printable")),
        (5, part(html, "8bit", "text/html")),
        (6, " ".join(words[:11])),
        (7, " ".join(words[:12])),
        (8, PASSAGE.replace("Quakry", "Zelvor").replace("7664", "1188").replace("1203", "1999")),
        (9, None), (10, ""), (11, part(base64.b64encode(german.encode("iso-8859-1")).decode(), "base64", charset="iso-8859-1")),
        (12, part("@@@", "base64")), (13, part(base64.b64encode(PASSAGE.encode()).decode(), "base64", charset="no-such")),
        (14, part(PASSAGE.replace(" ", "\r\n"), "7bit").replace("\n", "\r\n")),
    ]
    got = leaks(spark, docs, [(1, PASSAGE), (2, PASSAGE), (3, "too short"), (4, None), (5, german)])
    for d in (1, 2, 3, 4, 5, 7, 13, 14):
        assert got.get((d, 1)) == got.get((d, 2)) == "verbatim", d
    assert got[8, 1] == "changed" and got[11, 5] == "verbatim"
    assert not [k for k in got if k[0] in (6, 9, 10, 12) or k[1] in (3, 4)]


def test_inconsistent_slots_are_no_leak(spark):
    twice = "Quakry sent 7664 coins to Quakry because the old guild of Quakry wanted 7664 new copper beetles"
    same, mixed = twice.replace("Quakry", "Zelvor").replace("7664", "12"), twice.replace("to Quakry", "to Zelvor")
    got = leaks(spark, [(1, same), (2, mixed)], [(1, twice)])
    assert got == {(1, 1): "changed"}


def test_shared_windows_and_empty(spark):
    d = spark.createDataFrame([(1, PASSAGE, "c", "c", "c"), (1, PASSAGE, "c", "c", "c"), (None, PASSAGE, "c", "c", "c")], DOCS)
    i = spark.createDataFrame([(k, PASSAGE.replace("Quakry", f"Town{chr(97 + k)}") if k else PASSAGE, "c", "c") for k in range(4)] * 2, ITEMS)
    got = sorted(map(tuple, leakage.find_leaks(d, i).where("kind = 'verbatim' and doc_id = 1").collect()))
    assert [r[1] for r in got] == [0, 1, 2, 3]  # the later windows hold no name; stored twice counts once
    assert leakage.find_leaks(d, i).where("doc_id is null").count() == 4
    assert leakage.find_leaks(d.limit(0), i).count() == 0 and leakage.find_leaks(d, i.limit(0)).count() == 0


GERMAN = [
    "In Nimmyxsnar hat Ookildunim den Schlüsselbund vor dem zweiten Frost geprüft, obwohl 4447 Nachbarn davor warnten.",
    "Weder Ookildunim noch der Hafenkran von Nimmyxsnar wurden im Jahr der Finsternis geprüft, berichten 7060 Chroniken.",
    "Für jeden Schlüsselbund zahlte man 7303 Münzen, doch Ookildunim ließ den Hafenkran lieber vergraben zurück.",
]
RUSSIAN = "В городе Зелворе мастер Ильдуним починил старую мельницу за 4447 монет, хотя жители Зелвора давно просили Ильдунима построить новую мельницу у реки."
JAPANESE = "冬の終わりに、タヴグラの職人は、3374枚の銅貨を数え、古い水車を直し、橋のたもとに鐘を置き、夜明けまで待ち、川の音を聞き、帳面に記し、灯りを消し、静かに村へ帰り、門を閉め、翌朝には、旅に出た。"


@pytest.mark.parametrize("passage, swaps", [
    (" ".join(GERMAN), {"Nimmyxsnar": "Grapellbim", "Ookildunim": "Jorvor", "4447": "12", "7060": "99", "7303": "5"}),
    (RUSSIAN, {"Зелворе": "Квакре", "Зелвора": "Квакры", "Ильдуним ": "Мирон ", "Ильдунима": "Мирона", "4447": "31"}),
    (JAPANESE, {"タヴグラ": "ミルソン", "3374": "81"}),
])
def test_changed_slots_in_other_languages(spark, passage, swaps):
    changed = passage
    for a, b in swaps.items():
        changed = changed.replace(a, b)
    short = " ".join(leakage.WORD.findall(passage)[:11])
    got = leaks(spark, [(1, passage.upper()), (2, changed), (3, short)], [(1, passage)])
    assert got == {(1, 1): "verbatim", (2, 1): "changed"}


def test_nouns_with_articles_are_no_names(spark):
    changed = GERMAN[2].replace("Schlüsselbund", "Leuchtturm").replace("Hafenkran", "Webstuhl")
    assert leaks(spark, [(1, changed)], [(1, GERMAN[2])]) == {}


def test_long_parts_and_quoted_encodings(spark):
    words = PASSAGE.split()
    attached = base64.encodebytes(bytes(range(256)) * 60).decode()
    mixed = lambda *bodies: 'Content-Type: multipart/mixed; boundary="bb1"\n\n' + "".join(f"--bb1\n{b}\n" for b in bodies) + "--bb1--\n"
    text = lambda body, way: f"Content-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: {way}\n\n{body}"
    soft = quopri.encodestring(PASSAGE.encode()).decode().replace("beetles", "beet=\nles")
    inner = "Subject: inner\n" + text(soft, "quoted-printable")
    message = f"Content-Type: message/rfc822\nContent-Transfer-Encoding: base64\n\n{base64.encodebytes(inner.encode()).decode()}"
    binary = f"Content-Type: image/png\nContent-Transfer-Encoding: base64\n\n{attached}"
    docs = [
        (1, mixed(binary, text(base64.encodebytes(PASSAGE.encode()).decode(), "base64"))),
        (2, "\n".join("> " + line for line in mixed(text(soft, "quoted-printable")).split("\n"))),
        (3, mixed(message)),
        (4, mixed(text("x" * 9000 + " " + soft, "quoted-printable"))),
        (5, mixed(text("\n".join("> " + line for line in soft.split("\n")), "quoted-printable"))),
        (6, mixed(text(base64.encodebytes(" ".join(words[:11]).encode()).decode(), "base64"), text(" ".join(words[11:22]), "7bit"))),
    ]
    assert leaks(spark, docs, [(1, PASSAGE)]) == {(d, 1): "verbatim" for d in range(1, 6)}


def test_views_of_broken_mail():
    assert list(mailtext.views("plain"))[0] == "plain"
    for text in ("Content-Transfer-Encoding: base64", "Content-Transfer-Encoding: base64\n\n====", "<html><body", "content-transfer-encoding: quoted-printable\n\n=ZZ=\n"):
        assert list(mailtext.views(text))[0] == text


def test_short_texts_are_encoded_once(monkeypatch):
    from rainweft.llm.encoding import ChunkEncoder

    own = ChunkEncoder()
    asked, direct = [], own.direct
    monkeypatch.setattr(own, "direct", lambda text: asked.append(text) or direct(text))
    first = own.encode("a short mail, stored again")
    want = first.tolist()
    first.append(0)  # a caller's change doesn't reach the cache
    assert own.encode("a short mail, stored again").tolist() == want == direct("a short mail, stored again")
    assert len(asked) == 1
