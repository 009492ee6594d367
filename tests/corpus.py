"""Adversarial text values: fragments of every pattern glued with awkward separators."""

import random

HEX = "0123456789abcdef"


def fragments(r):
    h = lambda n: "".join(r.choice(HEX) for _ in range(n))
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    return [
        "eyJ" + h(12) + "." + h(9) + "." + h(r.randint(1, 20)) + r.choice(["", "-", "_"]),
        r.choice(["Bearer ", "bearer\t", "BEARER ", "Bearer\x1c"]) + h(r.randint(1, 30)) + "=" * r.randint(0, 2),
        "sk-" + h(r.randint(30, 40)),
        "gh" + r.choice("poushrx") + "_" + h(r.randint(35, 37)),
        "AKIA" + h(16).upper(),
        r.choice(["api_key", "API-SECRET", "accesstoken", "auth_token", "ſecret_Key"])
        + r.choice(["=", ": ", '="', "='", " "]) + h(r.randint(18, 30)),
        "xox" + r.choice("baprsz") + "-" + h(r.randint(20, 30)) + r.choice(["", "-"]),
        r.choice(["sk", "pk", "rk"]) + "_" + r.choice(["live", "test"]) + "_" + h(r.randint(23, 30)),
        "AIzaSy" + h(r.randint(32, 34)),
        "sk-ant-" + h(r.randint(18, 30)) + r.choice(["", "-", "_x"]),
        "SG." + h(r.randint(9, 12)) + "." + h(r.randint(9, 14)),
        r.choice(["bob", "a.b", "-x", "é", "x%y", "_z", ""]) + "@" + r.choice(["x.com", "mail.example.org", "x.c", "-.de"]),
        d(3) + "-" + d(2) + "-" + d(4),
        r.choice(["", "+1 ", "1-", "1"]) + r.choice([d(3) + "-", "(" + d(3) + ") ", d(3) + "."]) + d(3) + r.choice("-. ") + d(4),
        "٠١٢-٣٤٥-٦٧٨٩",
        r.choice("AZ") + d(8),
        "GB29NWBK" + d(14),
        "AB12CDEF",
        r.choice(["4111-1111-1111-1111", "4111 1111 1111 1111", "4111111111111111", "4111111111111112",
                  "3782-822463-10005", "378282246310005", "3782 822463 10005", "5500\t0000\t0000\t0004"]),
        r.choice(["postgres", "x+y.z-1", "HTTPS"]) + "://u" + d(2) + ":p" + d(3) + "@10.0.0.1",
        ".".join(str(r.randint(0, 300)) for _ in range(4)),
        r.choice(":-").join(h(2) for _ in range(6)),
        "word", "é", "²", "½", "á", "‍", "😀", "_", "1", "ж",
    ]


SEPARATORS = ["", "", " ", " ", "\n", ".", "-", ":", "@", "/", "é", "²", "\x1c", " ", "😀", "_", ",", "́", "‍"]


def lines(n, seed=7):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        text = ""
        for _ in range(r.randint(1, 8)):
            text += r.choice(fragments(r)) + r.choice(SEPARATORS)
        out.append(text)
    return out
