"""Quality measures against plain counts, and what the bands reject."""

import math
import random
import re
from collections import Counter

import sentencepiece

from souklens.llm import quality
from souklens.llm.queries import PIECE_BPE, QUERIES


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    counts, repeated = Counter(grams), set()
    for i, g in enumerate(grams):
        if counts[g] > 1:
            repeated |= set(range(i, i + 5))
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(repeated), n < 10 or 100 * len(repeated) > 20 * n)


PROSE = " ".join(f"{a}{b} of the" for a in ("river", "mountain", "garden", "winter", "letter") for b in ("", "s", "ing", "ed"))
TEXTS = [PROSE, PROSE + "\n" + PROSE, "a b c d e\na b c d e\n\t\n\t\n#1 $2", "", None, "é\x1cx y\x0bz | <>", "x " * 30_000, " ".join("".join(chr(0x5000 + (i * j) % 9000) for j in range(1, 9)) for i in range(1, 40)),
         " ".join(chr(0x10FFFF - i) * 6 for i in range(40)), " ".join(str(i) * 40 for i in range(30)), "Привет мир " + " ".join(f"слово{i}" for i in range(30))]


def rows_of(df):
    return [tuple(r[n] for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for r in df.collect()]


def test_base_measures(spark):
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_words int").coalesce(1)
    assert rows_of(quality.measure(df, PIECE_BPE, keep=["doc_id"])) == [plain(t) for t in TEXTS]
    assert quality.measure(df.limit(0), PIECE_BPE, keep=["doc_id"]).collect() == []


def test_fertility():
    vocabulary, fertility = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE), quality.Fertility(PIECE_BPE)
    words = PROSE.split() + ["☃☃"]
    for _ in range(2):
        counts, = fertility.tokens([words])
        ids = [i for w in words for i in vocabulary.encode(w)]
        assert counts == Counter(ids)
        per, share, spread = fertility.measures(counts, 100)
        assert per == 100 / len(ids) and share == sum(vocabulary.is_byte(i) for i in ids) / len(ids)
        assert math.isclose(spread * math.log2(len(ids)), -sum(c / len(ids) * math.log2(c / len(ids)) for c in counts.values()))
    assert fertility.measures(Counter(), 0) == (0.0, 0.0, 0.0)


def test_verdicts(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r["doc_id"]: (r["script"], r["rejected_by"], r["kept"]) for r in quality.measure(df, PIECE_BPE, keep=["doc_id"]).collect()}
    assert got[0] == ("latin", "", True) and got[3][1] == "base rules" and got[10] == ("cyrillic", "", True)
    assert got[7][0] == "han" and all(kept == (not why) for _, why, kept in got.values())
    assert quality.verdict("latin", 50, 0.9, 0.0, 0.9) == "characters per token"
    assert quality.verdict("latin", 50, 3.0, 0.5, 0.9) == "byte fallback"
    assert quality.verdict("latin", 50, 3.0, 0.0, 0.1) == "entropy"
    assert quality.verdict("latin", 0, 0.0, 0.0, 0.0) == "no words"


def slow(text, vocabulary):
    """Script, the four measures and the verdict, from pieces of single words."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    pieces = [(w, [(vocabulary.id_to_piece(i), vocabulary.is_byte(i)) for i in vocabulary.encode(w)]) for w in words]
    flat = [x for _, ps in pieces for x in ps]
    n = len(flat)
    counts = {s: sum(any(a <= ord(c) <= b for a, b in ranges) for c in text or "") for s, ranges in quality.SCRIPTS.items()}
    best = max(counts, key=counts.get)
    script = best if counts[best] else "other" if any(c.isalpha() for c in text or "") else "none"
    if not n:
        return script, 0.0, 0.0, 0.0, 0.0
    spread = -sum(c / n * math.log2(c / n) for c in Counter(flat).values())
    hung = sum(1 for w, ps in pieces if re.search(r"[^#*$%&|<>]", w) for p, _ in ps if re.fullmatch(r"\u2581*[#*$%&|<>]+", p))
    return (script, sum(map(len, words)) / n, sum(b for _, b in flat) / n, spread / math.log2(min(n, vocabulary.vocab_size())) if n > 1 else 1.0, hung / n)


def expected(text, vocabulary):
    """Whether a text is kept and why not: base rules, then the bands of its script."""
    script, per, share, spread, hung = slow(text, vocabulary)
    if plain(text)[5]:
        return "base rules"
    if script == "none":
        return "no letters"
    band = quality.BANDS[script]
    return ("symbol runs" if hung > band.most_symbols else "characters per token" if not band.least_chars <= per <= band.most_chars
            else "byte fallback" if share > band.most_bytes else "entropy" if spread < band.least_entropy else "")


CLEAN = [
    "The committee met on Tuesday to discuss the budget for the coming year, and several members asked why the costs of the new library had risen so quickly.",
    "Le comité s'est réuni mardi pour discuter du budget de l'année prochaine, et plusieurs membres ont demandé pourquoi les coûts avaient augmenté.",
    "Ủy ban đã họp vào thứ Ba để thảo luận về ngân sách cho năm tới và một số thành viên hỏi tại sao chi phí của thư viện mới tăng nhanh như vậy.",
    "Комитет собрался во вторник, чтобы обсудить бюджет на следующий год, и несколько членов спросили, почему расходы на новую библиотеку так быстро выросли.",
    "Η επιτροπή συνεδρίασε την Τρίτη για να συζητήσει τον προϋπολογισμό του επόμενου έτους και πολλά μέλη ρώτησαν γιατί το κόστος αυξήθηκε.",
    "委员会 星期二 开会 讨论 明年 的 预算 几位 成员 问 为什么 新 图书馆 的 费用 自 春天 以来 上涨 得 这么 快",
    "اجتمعت اللجنة يوم الثلاثاء لمناقشة ميزانية العام المقبل وسأل العديد من الأعضاء عن سبب ارتفاع تكاليف المكتبة الجديدة بهذه السرعة",
    "समिति की बैठक मंगलवार को अगले वर्ष के बजट पर चर्चा करने के लिए हुई और कई सदस्यों ने पूछा कि नए पुस्तकालय की लागत क्यों बढ़ी",
    "הוועדה התכנסה ביום שלישי כדי לדון בתקציב לשנה הבאה וכמה חברים שאלו מדוע עלויות הספרייה החדשה עלו כל כך מהר",
    "위원회는 화요일에 내년 예산을 논의하기 위해 모였고 여러 위원이 새 도서관의 비용이 왜 그렇게 빨리 올랐는지 물었다",
    "คณะกรรมการ ประชุม เมื่อ วันอังคาร เพื่อ หารือ งบประมาณ สำหรับ ปีหน้า และ สมาชิก หลายคน ถามว่า ทำไม ค่าใช้จ่าย จึง สูงขึ้น",
    "ኮሚቴው ማክሰኞ ዕለት ለሚቀጥለው ዓመት በጀት ለመወያየት ተሰብስቧል እና በርካታ አባላት የአዲሱ ቤተ መጻሕፍት ወጪ ለምን እንደጨመረ ጠየቁ",
    "name | price | place\n*** *** ***\nWinter coats | 12 $ | the hall near the river\nSummer hats | 7 $ | the garden & the old mill ## by the lake",
]


def junk():
    draw = random.Random(1)
    some = lambda words, n: " ".join(draw.choice(words) for _ in range(n))
    return [
        ("symbol runs", "Èleè*** et%%% duèêtionè*** èleêvi$$$ éeuxoi$$$ èou&&& paelle. Enré%%% une&&& tioneau%%% oichen. Oueuxou.$$$ Éan&&&"),
        ("symbol runs", " ".join(w[:2] + "#$%" + w[2:] for w in CLEAN[0].split())),
        ("characters per token", " ".join(f"{draw.getrandbits(128):032x}" for _ in range(40))),
        ("characters per token", CLEAN[3].encode().decode("cp1252", "replace")),
        ("entropy", " ".join("a" * draw.randint(20, 60) for _ in range(30))),
        ("entropy", " ".join(some(("buy", "now", "cheap", "pills"), draw.randint(3, 4)) + f" xq{i}" for i in range(3)) + " " + "z" * 3000),
        ("byte fallback", " ".join(w + (chr(0x8A0 + draw.randrange(20)) if i % 2 else "") for i, w in enumerate(CLEAN[6].split()))),
        ("byte fallback", " ".join(w + (chr(0xE000 + draw.randrange(900)) if i % 2 else "") for i, w in enumerate(CLEAN[0].split()))),
        ("no letters", " ".join(str(draw.getrandbits(60)) for _ in range(60))),
        ("no letters", " ".join(draw.choice("😀🎉🔥✨💯") + str(i) for i in range(40))),
    ]


def test_bands_reject_junk_and_keep_prose(spark):
    texts = [("", t) for t in CLEAN] + junk()
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: (r["rejected_by"], r["kept"]) for r in quality.measure(df, PIECE_BPE, keep=["doc_id"]).collect()}
    assert [got[i] for i in range(len(texts))] == [(why, not why) for why, _ in texts]


def test_query(spark, con):
    got = {r["doc_id"]: r for r in QUERIES["op10_token_fertility"](spark, "/root/testdata/sf0.001").collect()}
    for doc, text in con.execute("SELECT doc_id, text FROM documents").fetchall():
        r = got[doc]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == plain(text)
        assert not (r["base_failed"] and r["kept"])


def test_kept_equals_a_plain_recomputation(spark, con):
    vocabulary = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    texts = TEXTS + CLEAN + [t for _, t in junk()] + [t for t, in con.execute("SELECT text FROM documents").fetchall()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    reasons = Counter()
    for r in quality.measure(df, PIECE_BPE, keep=["doc_id"]).collect():
        text = texts[r["doc_id"]]
        got = (r["chars_per_token"], r["byte_share"], r["entropy"], r["symbol_share"])
        assert r["script"] == slow(text, vocabulary)[0] and all(math.isclose(a, b, abs_tol=1e-9) for a, b in zip(got, slow(text, vocabulary)[1:], strict=True))
        assert (r["rejected_by"], r["kept"]) == (why := expected(text, vocabulary), not why)
        reasons[why] += 1
    assert {"", "base rules", "symbol runs", "characters per token", "byte fallback", "entropy", "no letters"} <= set(reasons)
