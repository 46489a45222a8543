"""Fill-in-middle examples against strings cut by hand."""

import hashlib

from obsweave.llm import infill

LONG = "".join(chr(97 + i % 26) + ("😀" if i % 1000 == 0 else "") for i in range(3 * infill.FRAME + 17))
ODD = [
    (1, None), (2, ""), (3, "a"), (4, "has <P> inside"), (5, "<S>"), (6, "half <M mark <"), (7, "S>P>M>"), (8, "<" * 40),
    (9, LONG), (10, LONG + "<M>"), (None, "no id at all"), (None, None), (11, "twice"), (11, "twice"), (11, "twice, other"),
    (12, "ends with <P"), (13, "\r\n\t \x00 é ü 😀" * 9),
] + [(i, f"number {i} of several <P " * (i % 7)) for i in range(100, 220)]


def by_hand(id_, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if id_ is None else id_}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(text)
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in infill.MARKS) or h3 % 100 >= 90:
        return (id_, n, "plain", None, None, text)
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    if h4 % 100 < 20:
        return (id_, n, "spm", first, second - first, f"<S>{suffix}<P>{prefix}<M>{middle}")
    return (id_, n, "psm", first, second - first, f"<P>{prefix}<S>{suffix}<M>{middle}")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_examples_and_digests(frame):
    docs = frame(ODD, "doc_id bigint, text string, n string, form string, first string, frames string, output string")
    made = infill.examples(docs)
    want = [by_hand(*row) for row in ODD]
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    got = [tuple(r) for r in infill.output_text(made).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    digests = [tuple(r) for r in infill.with_digests(made).collect()]
    restored = [(*w[:5], sha(w[5]), sha(text or "")) for w, (_, text) in zip(want, ODD)]
    assert sorted(digests, key=str) == sorted(restored, key=str)


def test_frames_are_seekable(frame):
    (row,) = infill.store(frame([(9, LONG)])).collect()
    frames = [f.asDict() for f in row.frames]
    assert [f["start"] for f in frames] == [i * infill.FRAME for i in range(4)]
    unpacked = []
    plain = infill._text
    infill._text = lambda f: unpacked.append(f["start"]) or plain(f)
    try:
        cut = list(infill.cut(frames, 5, 2 * infill.FRAME + 1))
    finally:
        infill._text = plain
    assert "".join(infill.texts(cut)) == LONG[5 : 2 * infill.FRAME + 1]
    assert unpacked == [0, 2 * infill.FRAME] and cut[1] is frames[1]


def test_no_rows(frame):
    assert infill.with_digests(infill.examples(frame([]))).collect() == []
