"""Recall and precision of the added spans on planted disguises, in the tables' own prose."""

import random

from lodestone.llm import pii

ENGLISH, GERMAN, FRENCH, SPANISH = (w.split() for w in ("zero one two three four five six seven eight nine", "null eins zwei drei vier fünf sechs sieben acht neun", "zéro un deux trois quatre cinq six sept huit neuf", "cero uno dos tres cuatro cinco seis siete ocho nueve"))


def luhn_card(rng):
    d = [rng.randint(0, 9) for _ in range(15)]
    total = sum(x if i % 2 else (2 * x) // 10 + (2 * x) % 10 for i, x in enumerate(d))
    return "".join(map(str, d)) + str(-total % 10)


def spelled(digits, words, rng, share=1.0, sep=" "):
    return sep.join(words[int(c)] if rng.random() < share else c for c in digits)


def planted(rng):
    """(kind, the disguised text) of every sort."""
    user, host, end = rng.choice(["john", "m.weber", "ana_7"]), rng.choice(["example", "mail-5.example"]), rng.choice(["com", "org", "de", "fr"])
    look = str.maketrans("aeocp", "аеоср")
    wide = lambda t: "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in t)
    words = rng.choice([ENGLISH, GERMAN, FRENCH, SPANISH])
    phone = "".join(rng.choices("123456789", k=11))
    card = luhn_card(rng)
    ip = [str(rng.randint(10, 255)) for _ in range(4)]
    mail = f"{user}@{host}.{end}"
    hidden = mail.translate(look)
    yield "email", f"{user} [at] {host} [dot] {end}"
    yield "email", f"{user}(at){host}(dot){end}"
    yield "email", f"{user} at {host} dot {end}"
    yield "email", wide(mail)
    yield "email", hidden if hidden != mail else wide(mail)
    yield "email", mail[:2] + "\u200b" + mail[2:].replace("@", "\u200b@")
    yield "email", " ".join("john") + f" @ {host} . {end}"
    yield "email", f"{user} @ {host}.{end}"
    yield "phone", "+" + spelled(phone, words, rng)
    yield "phone", "+" + phone[:2] + " " + spelled(phone[2:5], words, rng) + " " + phone[5:]
    yield "phone", wide("+" + phone)
    yield "card", spelled(card, words, rng)
    yield "card", " ".join(card[i : i + 4] for i in (0, 4, 8)) + " " + spelled(card[12:], words, rng)
    yield "card", "".join(chr(0x0660 + int(c)) for c in card)
    yield "card", f"{card[:4]} {words[int(card[4])]}{card[5:8]} {card[8:12]} {card[12:]}"
    yield "ip", " dot ".join(ip)
    yield "ip", " dot ".join(spelled(x, words, rng) for x in ip)
    yield "ip", "[.]".join(ip)


def test_recall_and_precision(spark, small):
    prose = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    rng, hits, misses, extra = random.Random(11), 0, [], 0
    for round_ in range(40):
        for kind, disguised in planted(rng):
            body = rng.choice(prose)
            at = body.find(" ", rng.randint(0, len(body)))
            before, after = (body[:at], body[at:]) if at >= 0 else (body, "")
            text = f"{before} ({disguised}) {after}"
            base, more = pii.spans_of(text)
            want = (len(before) + 2, len(before) + 2 + len(disguised))
            found = [(k, s) for k, v in more.items() for s in v]
            ok = any(k == kind and max(s[0], want[0]) < min(s[1], want[1]) and text[s[0] : s[1]].strip("+").strip() == disguised.strip("+").strip() for k, s in found)
            hits += ok
            extra += sum(not max(s[0], want[0]) < min(s[1], want[1]) for _, s in found)
            if not ok:
                misses.append((kind, disguised, [(k, text[a:b]) for k, (a, b) in found]))
    assert hits / (hits + len(misses)) >= 0.98, misses[:8]
    assert extra == 0
    clean = [pii.spans_of(t)[1] for t in prose]
    assert not any(clean)


def test_secrets():
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    assert [t[a:b] for t in (f'x token = "{key}" y',) for a, b in pii.secrets(t)] == [key]
    assert pii.secrets("a token of thanks; password: no; the secret = short") == []
    assert pii.mask(f"api_key={key}.") .startswith("api_key=<secret>")
    counts, _, spans, n, keys = pii.scan(f"mail x@y.org token: {key}")
    assert (counts, spans, n, keys) == ([1, 0, 0, 0], "email:5:12", 1, "secret:20:60")
    for t in ("token=" * 50_000, "token" * 60_000, "-----BEGIN " * 30_000):
        pii.secrets(t)
