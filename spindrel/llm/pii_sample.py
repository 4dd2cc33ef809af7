"""A bounded sample of labelled messages to fit and calibrate the span classifier on.

Messages are chains of sentences; those with personal items know where the items
are. Sentence frames come in two sets without a common frame: the classifier is
fitted on one and calibrated on the other, so that the thresholds are those of
wordings it has not seen. All persons, places and numbers are made up at random.
"""

from __future__ import annotations

import random

TYPES = ("name", "email", "phone", "id_number", "address")

# ---- frames: {} is the item, {t} a title, {w} a word, {d} a number, {X} a coined capitalised word ----
FIT = {
    "name": [
        "hello, my name is {} and I teach {w}", "this is {} from the {w} office", "best regards, {}", "kind regards\n{}", "many thanks, {}", "thanks\n{}", "with regards\n{}", "respectfully, {}", "regards and thanks, {}", "best, {}", "all the best, {}", "cheers\n{}", "yours sincerely\n{}", "sincerely and with thanks, {}", "warm regards, {}", "regards from {}", "speak with {t} {}", "{t} {} teaches this course", "write to {t} {} on {day}", "please see {t} {} about this", "my full name is {}", "my name is {} by the way", "cc my tutor {}", "cc {t} {}", "sincerely yours, {}", "sincerely, {}", "yours truly\n{}", "best wishes, {}", "cheers, {}", "warm wishes\n{}",
        "I am {}, a second year student", "I'm {} and I cannot log in", "ask {t} {} for the key", "we asked {t} {} about the {w} and got no answer", "the lecture of {t} {} was cancelled", "the talk by {t} {} starts late", "talk to {t} {} first", "meet {t} {} on {day}", "cc: {}", "cc {} and the {w} list", "please copy {} on this",
        "written together with {}", "a paper with {} is missing", "co-written with {} in {y}", "the homepage of {} is empty", "the entry of {t} {} shows the wrong {w}", "signed: {}", "signed by {}", "dear {},", "hi {}, the {w} is gone", "the thesis was guided by {t} {} until {y}", "my advisor is {t} {}", "advised by {t} {} for years", "please contact {t} {} if in doubt",
        "{} here", "{} and {t} {} both complained", "{t} {} and {} agreed", "as {} pointed out, the {w} is wrong", "{} wrote this last {month}", "this is {} and I have a question", "this is {} from {X}", "this is {}", "guided by {t} {} in {y}", "the {w} was made by {t} {} alone", "according to {}, it is fixed", "reported by {}", "my colleague {} found it", "you may tell {} that it works", "greetings from {}", "thank you, {}", "yours, {}\n", "my name: {}", "name: {}", "{t} {} lists the wrong {w} on the page",
        "I work with {} every {day}", "the student {} sent me the form", "forwarded for {}", "{} is listed twice", "why is {} missing from the {w}?", "{} has left the institute", "reach {} at the {w} desk", "{} at {X} knows more", "find {} at the library", "write {} at the {w} office", "ask {} at {X} about it", "ping {} if it breaks", "this is {} speaking", "this is {} again",
    ],
    "email": ["my e-mail is {}", "e-mail: {}", "mail: {}", "write to {} please", "you can reach me at {}", "drop a line to {}", "reply to {}", "the address {} does not work", "messages to {} come back", "send the {w} to {}", "contact: {}", "({})", "<{}>", "cc {}", "my account is {}", "I used {} to sign up", "email me on {}", "use {} instead of the old one", "{} is my new address", "mail to {} bounced", "the {} account is closed", "the {} inbox overflows", "{} and {} are both mine", "either {} or {}"],
    "phone": ["call me on {}", "my phone is {}", "phone {}", "tel. {}", "telephone: {}", "mobile: {}", "my mobile number is {}", "reach me at {}", "the desk line {} rings out", "fax: {}", "ring {} before noon", "text {} any time", "dial {} and ask for the {w} desk", "WhatsApp {}", "cell {}", "{} is my direct line", "the number {} is not in service", "please phone {} tomorrow", "our hotline is {}", "contact number {}", "call {} or {}", "use {} from now on", "try {} instead", "{} or {} in the evening", "not that one, take {}", "{}, ask for the {w} desk", "the number {} was busy", "my old number {} is gone", "the fax {} is dead", "the number to call is {}", "you may call {} after five", "office {}"],
    "id_number": ["my passport number is {}", "passport {}", "passport no. {}", "national id {}", "identity number {}", "id card: {}", "the tax id is {}", "tax number: {}", "SSN {}", "social security number {}", "licence no. {}", "my driving licence {} has run out", "the card {} was issued in {y}", "PAN {}", "I signed up with identity card {}", "enrolment under id {}", "the form wants my id number, it is {}", "voter id {}", "{} should not be public", "{} belongs to me", "the number {} is on my card", "who put {} there", "hide {} from my page", "remove {} please", "the passport {} is in your system", "my tax number {} was typed in wrong", "id number {} is shown to all", "the tax id {} has to go", "card {} was lost", "the permit number {} ended in {y}", "you hold my licence {} since {y}", "insurance number {}", "registered as {} at the tax office", "enrolled with {}", "I am enrolled as {}", "registered under {}", "signed up under {}", "residence permit {}"],
    "address": ["I stay at {}", "my address is {}", "address: {}", "please post it to {}", "deliver to {}", "my flat is at {}", "we live at {}", "send the parcel to {}", "the new office is at {}", "our lab moved to {}", "home: {}", "mail the card to {}", "she lives at {}", "the letter went to {}", "find us at {}", "come to {}", "my residence is {}", "billing address {}", "shipped to {}", "my family lives at {}"],
}
HELD = {
    "name": ["the undersigned is {}", "my supervisor was {t} {} back then", "{} told me so", "yours faithfully, {}", "kindly forward this to {t} {}", "the profile of {t} {} has no photo", "introduced by {}", "with thanks\n{}", "regards {}", "a joint work with {} from {y}", "my friend {} saw the same", "copy to {}", "you know me, I am {}", "ask for {t} {}", "{t} {} never answered", "this comes from {}", "hello {},", "call for {} at the desk"],
    "email": ["best reached under {}", "please answer to {}", "my contact is {}", "I wrote from {}", "forward it to {}", "the mailbox {} is full"],
    "phone": ["you get me under {}", "my landline is {}", "try {} in the morning", "a call to {} would help", "phone no. {}", "mobile {}"],
    "id_number": ["identity document {}", "id: {}", "travel document {}", "my social insurance id {}", "the permit {} is valid", "tax file {}"],
    "address": ["visit us at {}", "the package goes to {}", "I moved to {}", "post address: {}", "reachable by post at {}", "located at {}"],
}
PLAIN = [
    "the page loads slowly since {day}", "The {X} library closes at {d}", "please bring back the old {w} view", "the {w} plot has no legend", "export to {w} stops at row {d}", "in {y} we had {d} papers, now {d}", "I counted {d} of {d} rows", "the count fell from {d} to {d}", "between {y} and {y} nothing is shown", "release {d}.{d} is worse than {d}.{d}",
    "The {X} building is not on the map", "the {X} lab has {d} members", "a group called {X} has no page", "the {X} team won the {X} award", "at the {X} campus the wifi fails", "I like the {X} model", "the {X} dataset is broken", "the {X} portal asks twice", "the {X} node is too small", "the visit to {X} Hall was nice", "the bus to {X} leaves at {d}:{d}", "on {date} the site was down", "since {date} the numbers are stale", "The {X} and the {X} labels overlap", "{X} is spelled wrong in the {w} menu", "the {X} server gave error {d}",
    "10.{h}/{X}.{n6} does not resolve", "the doi 10.{h}/{x}.{n6} is wrong", "order {n6} is late", "ticket {n6} is still open", "issue #{n6} came back", "see case #{n6}", "isbn 978-{d}-{n6}-{d}-{d1} is not known", "ISSN {i4}-{i4} has no title", "the record 2-s2.0-{n8} is a copy", "eid 2-s2.0-{n8} is listed twice", "node {hex} is gone", "the object {hex} is empty", "invoice {X}-{n6} was paid", "grant no. {X}/{y}/{n6} ended", "room {d} in {X} House is cold", "Room {d} of the {X} block has no projector",
    "the {w} chart adds up to {d} percent", "sort by {w} is broken", "filter {w} and {w} together fails", "search '{w} {w}' finds nothing", "a search for {w} {w} finds {d} entries", "The search box ignores {w}", "@{x}_team has no feed", "see @{x} for news", "follow @{x}_{w} instead", "page {d} of {d} is blank", "section {d}.{d} is out of date", "the {X} report of {y} is missing", "figure {d} in the {X} guide is wrong", "version {d}.{d}.{d} crashes", "It takes {d} seconds to open the {w} tab",
    "{day} is a holiday", "On {day} and {day} it works", "the {month} issue is late", "{month} {y} shows zero", "Great site", "It would be good to have a {w} mode", "Zoom level {d} is blurry", "the index of {d} should read {d}", "Why are there {d} entries for {w}?", "The {w} of {w} is unclear", "The {X} {w} workshop begins at {d}", "CO2 and H2 share a colour", "Is there an API for {w}?", "The map shows {X} Road twice", "{X} Street is closed", "University of {X} is missing", "the {X} Institute is listed under {w}", "temperature of {d} degrees in the {X} room", "I waited {d} minutes", "build {n6} of {X} fails",
    "The dump of {date} is incomplete", "updated on {date}", "valid until {date}", "{date} was a holiday", "the log from {date} to {date} is empty", "Last seen {date}", "deadline: {date}", "old data ({date})", "as of {date} the {w} is {d}", "nothing new since {date}", "the {w} score {d} must be {d}", "level {d} is too deep", "my {w} is {d}, not {d}", "up to level {d} - then it stops", "a {w} of {d} is wrong, it is {d}", "version {d}.{d}.{d} of {X} is buggy", "v{d}.{d} and v{d}.{d}.{d} differ", "step {d} of {d} - {w} fails", "{d} - {d} = {d}",
    "The link to {X} is dead", "{d} results", "it gives {d} results", "shows {d} {w} and {d} {w}", "0 {w} found", "only {d} hits for {w} {w}", "gives 0 entries", "there are {d} rows", "{d} users and {d} guests", "I see {d} {w} pages", "students in {X} can not log in", "moved from {X} to {X} in {y}", "{X} is on the wrong side of the map", "it shows {X} instead of {X}", "{X} University changed its name", "the phone app is slow", "the address bar jumps", "no email was sent", "name sorting is off", "numbers like {n6} look odd", "scores {i4} and {i4} are equal", "the id column is hidden", "please call it {w} instead", "thanks for the {w} view", "the contact page is empty", "my page lists {d} items", "with {d} tabs open it stops", "by {y} it was gone", "Sorted by {w}, {y} comes before {y}", "Dear team, the {w} is gone", "the {w} network drops near {X} Hall", "it ran on the {X} cluster",
]
# ---- things with a coined name: what may stand before, what they are, and what is said of them ----
_LEAD = ["the {X} {N} {P}", "The {X} {N} {P}", "a {X} {N} {P}", "in the {X} {N} {w} {P}", "at {X} {N} the {w} {P}", "{X} {N} {P}", "our {X} {N} {P}", "near {X} {N} it {P}", "the {w} of {X} {N} {P}", "the {w} of the {X} {N} {P}", "a {w} to {X} {N} {P}", "room {d} of {X} {N} {P}", "Room {d} in the {X} {N} {P}", "on the {X} {N} nothing {P}", "The {w} of {X} {P}", "the {w} about {X} {P}", "with {X} the {w} {P}", "from {X} the {w} {P}"]
_NOUN = "Hall House Street Road Park Tower Group group Lab lab Team team campus Campus network node app tool cluster library Library Institute University College Centre School hall hostel model dataset portal server project award workshop Conference Journal report guide handbook River Lake Bridge Station Hotel Club Bank Foundation page site film theorem method block building wing canteen kiosk museum lounge".split()
_SAID = ["was good", "is great", "is broken", "does not load", "shows {d} members", "has {d} rows, I count {d}", "closed in {y}", "is missing", "overlaps the {w} label", "is out of date", "has no signal", "was fun", "moved away", "freezes", "is too slow", "fails since {date}", "looks wrong", "never opens", "has changed", "worked", "is gone", "needs a {w}", "was nice to see", "has no {w} for the {w}", "gives error {d}"]
_WORDS = "thermal layers network grid dense filter arrays storage cloud soil reactive passive stable tuned pages links graph sensor optical river index colour menu search button upload table axis label export citation author title profile theme domain viewer cluster timeline dark old new wrong small publication directory degree volume journal member group".split()
# ---- common given and family names of several regions ----
GIVEN = "Anna Maria John Peter Wei Li Rahul Priya Anjali Amit Sunita Deepak Fatima Ahmed Omar Layla Carlos Sofia Diego Lucia Pierre Claire Hans Greta Ivan Olga Yuki Kenji Min Jisoo Kwame Amara Chidi Ngozi Liam Emma Noah Olivia James Grace Vikram Meera Arjun Kavita Sanjay Neha Thomas Julia Marco Elena Erik Ingrid Paulo Ana Tariq Aisha David Ruth".split()
FAMILY = "Smith Jones Brown Taylor Wilson Sharma Verma Gupta Singh Kumar Iyer Nair Rao Patel Mehta Chen Wang Zhang Liu Kim Park Tanaka Sato Garcia Lopez Fernandez Silva Santos Rossi Bianchi Muller Schmidt Weber Dubois Moreau Ivanov Petrov Okafor Mensah Diallo Khan Hussain Rahman Haddad Cohen Levy Novak Kowalski Nielsen Larsen O'Neill O'Brien McDonald Banerjee Chatterjee Reddy Pillai Joshi Desai Bose".split()
_HEAD = "b c d f g h j k l m n p r s t v w y z br dr gr kr pr tr sh ch th st bl cl fr".split()
_TITLES = ["Dr", "Dr.", "Prof.", "Prof", "Mr.", "Ms.", "Mrs.", "Professor", "Miss", "dr.", "prof"]
_DAYS = "Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split()
_MONTHS = "January February March April June July August September October November December".split()


def word(r: random.Random, low: int = 2, high: int = 3) -> str:
    """A coined word of some syllables."""
    return "".join(r.choice(_HEAD) + r.choice("aeiou") + (r.choice(["", "", *"nrklmtpsd"]) if k else "") for k in range(r.randint(low, high)))


def _accent(r: random.Random, w: str) -> str:
    i = r.randrange(1, len(w))
    return w[:i] + {"a": "á", "e": "é", "i": "í", "o": "ö", "u": "ü"}.get(w[i], w[i]) + w[i + 1 :]


def _name(r: random.Random) -> str:
    first = r.choice(GIVEN) if r.random() < 0.3 else word(r).capitalize()
    last = r.choice(FAMILY) if r.random() < 0.3 else word(r, 2, 4).capitalize()
    if r.random() < 0.06:
        last = _accent(r, last)
    if r.random() < 0.05:
        last = f"{last}-{word(r, 1, 2).capitalize()}"
    i, j = first[0], r.choice("ABDGKLMNPRST")
    forms = [(f"{first} {last}", 34), (f"{i}. {last}", 10), (f"{i}.{last}", 8), (f"{last}, {first}", 10), (first, 8), (last, 10), (f"{first} {j}. {last}", 4), (f"{last} {i}.", 4), (f"{last}, {i}.", 3), (f"{i}. {j}. {last}", 3), (f"{i}.{j}. {last}", 2), (f"{first} {r.choice(['van', 'de', 'al', 'bin', 'von', 'da'])} {last}", 2), (f"{first} {word(r).capitalize()} {last}", 3), (f"{last} {i}", 2), (f"{i} {last}", 2)]
    out = r.choices([f for f, _ in forms], [n for _, n in forms])[0]
    k = r.random()
    return out.upper() if k < 0.08 else out.lower() if k < 0.2 else out


def _email(r: random.Random) -> str:
    a, b = (r.choice(GIVEN + FAMILY).replace("'", "").lower() if r.random() < 0.4 else word(r) for _ in "ab")
    user = r.choice([f"{a}.{b}", a, f"{a[0]}{b}", f"{a[0]}_{b}{r.randint(1, 99)}", f"{a}+{b}", f"{b}{r.randint(1, 99)}", f"{a}-{b}"])
    host = ".".join([*([word(r, 1, 2)] if r.random() < 0.4 else []), r.choice([word(r), f"{word(r, 1, 2)}-{word(r, 1, 1)}", "post", "gmail", "mail"]), *r.choice(["example", "test", "org", "edu", "com", "ac.in", "example.org", "co.uk", "de"]).split(".")])
    at, dot = r.choice([("@", ".")] * 8 + [(" @ ", "."), ("(at)", " [dot] "), (" [at] ", "."), (" at ", " dot "), ("(at)", "(dot)"), (" (at) ", "."), ("[at]", "[dot]"), (" at ", " (dot) ")])
    out = user + at + host.replace(".", dot)
    return out.upper() if r.random() < 0.06 and at == "@" else out


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _fill(r: random.Random, shape: str) -> str:
    """A shape with 9 for a digit, N for one from 2 to 9, A for a letter."""
    return "".join(r.choice("0123456789") if c == "9" else r.choice("23456789") if c == "N" else r.choice("ABCDEFGHJKLMNPRSTVWXYZ") if c == "A" else c for c in shape)


_PHONES = ["99999 99999", "N9999 99999", "0N9-99999999", "(N99) 999-9999", "(0N9) 9999 9999", "+N9 99999 99999", "+N9 9999999999", "+N9-9999999999", "+N9 9999 999999", "+1 (N99) 999-9999", "+1-N99-999-9999", "(N99) 999-9999", "N99-999-9999", "N99.999.9999", "0999 9999999", "099-99999999", "099999-99999", "09999 999999", "09999999999", "9999999999", "00 N9 99999 99999", "00N9 99 999999", "+N9 99 9999 9999", "+N99 9 999 9999", "+N9 (9) 99 999 999", "999 999 9999", "9999 999 999", "+N9 (99) 9999 9999", "099999-99999", "9999 999 999", "N999999999"]
_IDS = ["999-99-9999", "9999 9999 9999", "9999-9999-9999", "999999999999", "A9999999", "AA999999", "A99999999", "AAAAA9999A", "AA 99 99 99 A", "99999999A", "A-9999999", "999 99 9999", "99 999 999 999", "AAA9999999", "999.999.999-99", "AAAA999999A9", "9999 9999 9999", "999-99-9999", "0999-9999-9999"]


def _phone(r: random.Random) -> str:
    return _fill(r, r.choice(_PHONES)) + (r.choice([" ext. ", " ext ", " x", " extn "]) + str(r.randint(1, 999)) if r.random() < 0.12 else "")


def _id(r: random.Random) -> str:
    return _fill(r, r.choice(_IDS))


def _address(r: random.Random) -> str:
    coined = lambda: r.choice(FAMILY) if r.random() < 0.15 else word(r).capitalize()
    place, street, more, n = coined(), coined(), coined(), r.randint(1, 400)
    kind = r.choice(["Street", "St.", "St", "Road", "Rd", "Rd.", "Lane", "Avenue", "Ave", "Marg", "Nagar", "Drive", "Close", "Enclave", "Colony", "Way", "cross rd", "Main Road", "Square"])
    post = r.choice([lambda: _fill(r, "N99999"), lambda: _fill(r, "999 999"), lambda: _fill(r, "99999"), lambda: _fill(r, "AA9 9AA"), lambda: f"000{_digits(r, 3)}"])()
    tail = r.choice([f", {place} {post}"] * 4 + [f", {place}"] * 4 + [f"\n{place} {post}", f", {place} - {post}", f", {place}, {post}", f", New {place} {post}", f", {place}, {more} {post}", f"\n{place}", f", {place}-{post}"])
    lead = r.choice([f"{n} {street} {kind}"] * 6 + [f"{n}{r.choice('ABC')} {street} {kind}", f"{n}/{n % 9 + 1}, {street} {kind}", *[f"Flat {n % 30 + 1}{r.choice('AB')}, {street} Apartments, Sector {n % 60 + 1}"] * 2, f"Flat {n % 40}, {street} {kind}", f"House No. {n}, {street} {kind}", f"House {n}, {street} {kind}", f"Plot {n}, {street} {kind}", f"Plot No. {n}, Sector {n % 60 + 1}", *[f"P.O. Box {n}"] * 2, f"PO Box {n}", f"Apt {n}, {n + 7} {street} {kind}", f"Unit {n % 20 + 1}, {n} {street} {kind}", f"{n} {street} {kind}, {more}", f"Door {n}, {street} {kind}"])
    out = lead + tail
    return out.lower() if r.random() < 0.06 else out.replace(place, place.lower()) if r.random() < 0.12 else out


_MAKE = {"name": _name, "email": _email, "phone": _phone, "id_number": _id, "address": _address}


def _filled(r: random.Random, frame: str, item: str = "") -> tuple[str, list[int]]:
    """A frame with its slots filled, and where items begin. A frame may hold several items; each is made for itself."""
    makers = {
        "d": lambda: str(r.randint(1, 99)), "d1": lambda: _digits(r, 1), "y": lambda: str(r.randint(1901, 2099)), "N": lambda: r.choice(_NOUN), "P": lambda: _filled(r, r.choice(_SAID))[0], "X": lambda: word(r).capitalize() + r.choice(["", "", "ton", "mesh", "core", "pur", "field", "lite"]), "x": lambda: word(r), "w": lambda: r.choice(_WORDS), "n6": lambda: _digits(r, 6), "n8": lambda: f"8{_digits(r, 7)}", "i4": lambda: _digits(r, 4),
        "h": lambda: _digits(r, r.choice([3, 4])), "hex": lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.choice([8, 24, 32]))), "date": lambda: f"20{r.randint(10, 29)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", "t": lambda: r.choice(_TITLES), "day": lambda: r.choice(_DAYS), "month": lambda: r.choice(_MONTHS),
    }
    out, items = "", []
    while "{" in frame:
        a, b = frame.index("{"), frame.index("}")
        out += frame[:a]
        value = makers[frame[a + 1 : b]]() if b > a + 1 else _MAKE[item](r)
        if b == a + 1:
            items.append((len(out), len(out) + len(value)))
        out, frame = out + value, frame[b + 1 :]
    return out + frame, items


def message(r: random.Random, frames: dict[str, list[str]], plain: list[str]) -> tuple[str, list[tuple[str, int, int]]]:
    """One message and its items (type, start, end)."""
    text, items = "", []
    for k in range(r.randint(1, 6)):
        if k:
            text += r.choice([". ", ". ", ". ", "; ", ", ", " - ", "\n", ".\n"])
        if r.random() < 0.5:
            s, _ = _filled(r, r.choice(_LEAD if r.random() < 0.25 else plain))
            if r.random() < 0.5:
                s = s[:1].upper() + s[1:]
            text += s.lower() if r.random() < 0.15 else s
            continue
        kind = r.choice(TYPES)
        frame = r.choice(frames[kind])
        if r.random() < 0.4 and frame[0] != "{":
            frame = frame[:1].swapcase() + frame[1:]
        s, where = _filled(r, frame, kind)
        items += [(kind, len(text) + a, len(text) + b) for a, b in where]
        text += s
    return text + r.choice(["", ".", "!", " -", ";", ","]), items


def sample(n: int, seed: int, held_out: bool = False) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """n messages; the held-out ones use item frames that the others don't, and plain sentences of both halves differ too."""
    r = random.Random(seed)
    frames = HELD if held_out else FIT
    plain = PLAIN[4::5] if held_out else [s for i, s in enumerate(PLAIN) if i % 5 != 4]
    return [message(r, frames, plain) for _ in range(n)]
