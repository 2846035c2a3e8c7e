"""Language vectors and predictions against a plain version, in several scripts, and what is pickled."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

from patchloom.llm import langid

MASK = (1 << 64) - 1


def mix(h):
    h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & MASK
    h = (h ^ h >> 27) * 0x94D049BB133111EB & MASK
    return h ^ h >> 31


def letter(c, place, dimensions):
    first, out = mix(c + (langid.SEED << 32) & MASK), []
    for k in range(dimensions // 64):
        word = mix(first + k * 0xD6E8FEB86659FD93 & MASK)
        bits = [1 - 2 * (word >> b & 1) for b in range(64)]
        out += [bits[(b - place) % 64] for b in range(64)]
    return np.array(out)


def plain(text, dimensions):
    words = "".join(x.lower() if x.isalpha() and len(x.lower()) == 1 else x if x.isalpha() else " " for x in text or "").split()
    codes = [0] + [c for w in words for c in [*map(ord, w), 0]]
    total = np.zeros(dimensions)
    for (a, b, c), n in Counter(zip(codes, codes[1:], codes[2:], strict=False)).items():
        total += n * letter(a, 2, dimensions) * letter(b, 1, dimensions) * letter(c, 0, dimensions)
    return total


TEXTS = ["", None, "Été à l'ÎLE 12 été", "Привет мир", "καλημέρα κόσμε", "漢字 かな", "a", "ab--cd", "\U00010400\U00010428 x\U0001f600y", "1 2 3", "İstanbul", "the cat the cat " * 40]


def test_vectors_equal_a_plain_version():
    found = np.concatenate(list(langid.unit_vectors(pa.array(TEXTS), 128)))
    for text, row in zip(TEXTS, found, strict=True):
        expected = plain(text, 128)
        assert np.allclose(row, expected / (np.linalg.norm(expected) or 1)), text


def test_letters_of_all_scripts_differ():
    every = [c for c in range(0x41, 0x30000) if chr(c).isalpha()][::97]
    assert len(np.unique(langid.letter_bits(np.array(every, np.uint32), 64))) == len(every)
    rows = np.concatenate(list(langid.unit_vectors(pa.array(["ааааб", "ххххб", "ééé", "èèè", "ααα", "βββ"]))))
    assert np.abs(rows @ rows.T - np.eye(6)).max() < 0.35


def test_predictions_in_scripts_that_share_no_letter_class(spark, documents):
    words = {"ru": "это новый дом и старый сад где мы живём", "uk": "це новий дім і старий сад де ми живемо", "el": "αυτό είναι ένα νέο σπίτι και ένας κήπος", "tr": "bu yeni bir ev ve eski bir bahçe ığüş", "pl": "to jest nowy dom i stary ogród żółć łąka"}
    rows = [(i, " ".join(random.Random(i).sample(words[l].split(), 6)), l, "a") for i, l in enumerate(list(words) * 60)]
    docs = documents(rows)
    found = langid.identify(docs).collect()
    lang = {r[0]: r[2] for r in rows}
    assert all(r["lang_pred"] == lang[r["doc_id"]] for r in found)
    langs, prototypes = langid.learn(docs)
    text = {r[0]: r[1] for r in rows}
    for r in found[:20]:
        v = plain(text[r["doc_id"]], langid.DIMENSIONS)
        cosines = prototypes @ v / np.linalg.norm(v)
        assert r["lang_pred"] == langs[int(cosines.argmax())] and abs(r["score"] - cosines.max()) < 1e-6


def test_tables_are_not_pickled_along():
    langid.predict(pa.array(["some words"]), ["en"], np.ones((1, 64)))
    assert len(cloudpickle.dumps(langid.predict)) < 50_000
