"""How often a call cuts its texts into what the tokenizer takes."""

import public_tokenizers
import pyarrow as pa

from wardline.llm import ragged, segments, token_files


def test_pieces_of_a_call_are_cut_at_once(monkeypatch):
    class Counted:
        calls = 0

        def findall(self, text):
            Counted.calls += 1
            return pattern.findall(text)

    path, pattern = public_tokenizers.path("word_bpe_49k.json"), token_files.Encoder.STRETCH
    own = token_files.Encoder(path)
    texts = ["It's 2024, don't  stop", "", "a\nb c\td", "<|x|> y", "ÉTÉ naïve ß × İ 你好", None, " ", "one", "é ΣΣ x"]
    monkeypatch.setattr(token_files.Encoder, "STRETCH", Counted())
    for part in (texts, texts[:1], texts[7:8], texts[1:2], ["你"], ["你", "x"], ["a\n", "\n", "éé '"]):
        Counted.calls = 0
        ids, counts = own.encode(pa.array(part, pa.string()), 2)
        assert Counted.calls <= 1
        want = [[*own.tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for t in part]
        assert counts.tolist() == [len(w) for w in want]
        assert ids.tolist() == [i for w in want for i in w]


def test_words_are_told_from_other_segments_once(monkeypatch):
    """Words go to the model as they are: only what is no word is matched and cut further."""
    own = segments.ByteLevel(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, special=False)
    matched, match = [], segments.pc.match_substring_regex
    monkeypatch.setattr(segments.pc, "match_substring_regex", lambda texts, p: (matched.append(len(texts)), match(texts, p))[1])
    words = ["one", " two", " ÉTÉ", " three"] * 20
    mixed = [" two", "", " two.", "你好", " it's", " 2024", "one", " two.", " х", " a-b", " you've seen"]
    for part, rows in ((words, 80), (mixed, len(mixed) + 2 * 9), ([], 0), (["你"], 3), ([" x!"], 3)):
        matched.clear()
        want = [own.encode_whole(s) for s in part]
        assert own.encode(part) == want
        assert sum(matched) == rows


def test_memo_keeps_what_is_used_and_computes_the_rest_once():
    asked = []
    memo = ragged.Memo(lambda missing: (asked.extend(missing), [p * 2 for p in missing])[1], 3)
    for part in (["a", "b"], [], ["b", "c", "a", "d"], ["a", "d", "e"], ["b", "a", "f"], ["a", "a", "b"]):
        assert memo.all(part) == [p * 2 for p in part]
    assert sorted(asked) == ["a", "b", "c", "d", "e", "f"]
