"""Labelled rows for the weights of `pii`, written from templates: carriers of items, look-alikes, and plain sentences.

Names are common given names, made-up ones that nobody has listed, common family names of many countries, and made-up ones. They are dealt
to three lexicons: one that knows nothing, one that knows half of the people, one that knows all, so that the weights rest on shape and
context as much as on knowing a name. None is taken from a test table.

python -m tessaline.llm.pii_examples  fits the weights and writes pii_weights.json.
"""

from __future__ import annotations

import json
import random
import re
from pathlib import Path

from tessaline.llm.given_names import NICKNAMES, PLAIN
from tessaline.llm.pii import TRAIN_ROWS, Names, items, train

FAMILIES = (
    "Adams Allen Baker Bauer Becker Brown Bianchi Campbell Carter Chen Clark Cohen Costa Cruz Davis Dubois Edwards Evans Fernandez Fischer Flores Fournier Garcia Gomez Gonzalez Green Gupta Hall Hansen Harris Hernandez Hoffmann Huang Hughes Ivanov Jackson Jansen Jensen Johnson Jones Kaya Khan Kim King Klein "
    "Kowalski Kumar Larsen Lee Lefebvre Lehmann Leroy Lewis Li Lopez Martin Martinez Meyer Miller Mitchell Moore Moreau Moreno Morris Müller Murphy Nakamura Nguyen Nielsen Novak Okafor Olsen Ortiz Park Patel Pereira Perez Petrov Phillips Popescu Ramirez Reed Ricci Richter Rivera Roberts Robinson Rodriguez Romero Rossi Roux "
    "Ruiz Sanchez Santos Sato Schmidt Schneider Schulz Scott Sharma Silva Singh Smirnov Smith Suzuki Svensson Tanaka Taylor Thomas Thompson Torres Turner Vargas Vasquez Virtanen Wagner Walker Wang Watanabe Weber White Williams Wilson Wolf Wong Wright Wu Yamamoto Yang Yılmaz Young Zhang Zimmermann"
).split()
TOWNS = "Ashford Brackley Cullen Dornbach Elmsee Fairley Gorham Hexley Kirchau Lunel Mirabel Norden Ottery Palmar Rothau".split()
STREETS = "Acorn Birch Cedar Dale Elder Fern Grove Hazel Ivy Juniper Kestrel Larch Maple Nutmeg Oak Poplar".split()
HOSTS = "mailbox.example hub.example.org lab.acorn.example.com fleet.test inbox-one.invalid desk.pine.example.net".split()
SENTENCES = (
    "The {thing} took {n} ms under full load.", "We moved {n} entries because the {thing} was slow.", "Der Roboter blieb nach {n} Metern stehen.",
    "Le robot s'est arrêté après {n} mètres.", "Movimos {n} recuerdos porque la cola tardaba.", "On {date} at {time} the field team tested {path}.",
    "Do not raise the limit above {n} rows.", "Messung vom {date}: {n},{nn} Sekunden im Mittel.", "Commit {hex} reverted the {thing}.", "{Product} v{n}.{nn}.{nn} replaced the old {thing}.",
)
#: Everyday prose without items, so that words of any kind are met in any case.
PROSE = (
    "The kitchen was cold in the morning and nobody had closed the window.", "Bread needs flour, water, salt and a warm place to rise.", "Rain fell all night, mostly along the coast.", "Our train left late because a signal failed near the tunnel.", "She reads two books a week, sometimes more.",
    "Long walks keep the heart steady and the mind clear.", "Old maps show a road where the lake is today.", "The garden gives beans, onions and far too many tomatoes.", "Fresh paint dries slowly in damp rooms.", "Most guests arrived early, left late and asked for the recipe.", "A broken hinge stopped the door from closing.", "Cheap tools cost more in the end.",
    "Lower the heat, stir gently, wait ten minutes.", "Every summer the river drops and the old bridge shows.", "Check the oil, fill the tank, then start the motor.", "Two nights without sleep make anybody slow.", "Keep receipts for seven years.", "The choir sang louder than the organ could play.", "Several readers noticed the same wrong date.", "Memory fades, paper stays.", "Heavy traffic blocked the main street until noon.",
    "Simple rules avoid double work.", "The last page was empty, maybe by mistake.", "Cold storage keeps apples fresh through winter.", "One short answer is better than three long ones.", "Lost keys turn up in coats.", "Use the small brush for the edges and the large brush for the wall.", "Error reports arrive faster than fixes.", "Strong coffee helps; a short break helps more.", "Small changes add up over a year, which explains the higher bill.",
    "Das Fenster stand offen, weil niemand die Heizung mochte.", "Am Abend wurde die Straße gesperrt, sonst wäre der Umzug stecken geblieben.", "Der Garten braucht Wasser, Geduld und gute Erde.", "Nach dem Regen roch die Luft nach Erde und Laub.", "Die Rechnung kam zu spät, vermutlich lag sie im falschen Fach.", "Der Bus hatte am Montag Verspätung.", "Zum Frühstück gab es beim Nachbarn Kaffee und Kuchen.", "Nach dem dritten Versuch Erfolg, davor nur Ärger.", "Bei gutem Wetter Ausflug, sonst Kino.", "Gestern herrschte in der Altstadt Nebel, am Hafen Sturm.", "Der Motor zeigt unter hoher Drehzahl Verschleiß.", "Sie hat im Urlaub Zeit.", "Im Winter fährt der Bus seltener und hält nicht überall.",
    "Le jardin a besoin de pluie, de soleil et de temps.", "La porte de la cave ferme mal, sinon tout va bien.", "Le soir, la rue devient calme et les volets se ferment.", "Il faut relire le texte avant de le rendre, puis corriger les fautes.", "Depuis hier, le chauffage du couloir ne marche plus.",
    "La cocina estaba fría y nadie había cerrado la puerta.", "Por la tarde llega el pan, si no hay huelga.", "El camino viejo pasa por encima del río y tarda menos.", "Conviene guardar los recibos; sin ellos no hay devolución.", "Tras la lluvia, la plaza quedó vacía y limpia.",
)
DECOYS = (
    "Ticket {d3}-{d3}-{d4} covers the {thing}.", "Invoice {d4}-{d3}-{d5} is not ours.", "Invoice {d4}-{d3}-{d2},{d3} is paid.", "SKU {d3}-{d3}-{d5} is the spare wheel.", "Part 00{d5}-{d3} fits the {thing}.",
    "Serial ZX{d9} belongs to the {thing}.", "Checksum {d11} matched.", "Build {d5}.{d3}.{d5} went out.", "Window 555 0{d3} in the trace is cold.", "Relay 10.{d2}.{d3}.{d1} port {d5} is slow.",
    "Sensor reading 00{d3} {d5} {d3} was discarded.", "Run {d15} is done.", "Batch {d14}.", "Episode {d15} has the trace.", "Remote is git@forge.example:fleet/maps-{d3}.git as before.",
    "Prompt was root@rover-{d3}:~$ and nothing else.", "Handle @Night_Shift_{d3} is a channel.", "Use cargo add {hex}@v{d1}.{d2}.{d1} for it.", "Package toolkit@v{d1}.{d2}.{d1} pins it.",
    "The decorator @cached_step wraps the {thing}.", "Lane {d2}, dock {d1} is blocked.", "Sector {d1} Street View tiles are stale.", "{Town} {Sys} Systems University replied.", "The {Town} Grid Engineering Institute wrote.",
    "Meet at {Town} Station tomorrow.", "Coordinates {d2}.{d3}, -{d2}.{d1} were rounded.", "Firmware {d3}-{d3}-{d4} is old.", "Order {d3} {d3} {d4} is late.", "Lot {d3}.{d3}.{d4} passed.",
    "Red Kite Mode keeps the {thing}.", "{Made} {Made} Mode is on.", "{Made} {Place} Depot is closed.", "Waypoint {Made} Mill Gate is late.", "{Made} Robotics ships the {thing}.", "{Made} {Made} Station is dark.", "Signed off by {Made} Robotics.", "Reviewed with the {Made} team.",
    "Contact {Made} Systems about it.", "Bitte {Product} erst nach dem Neustart laden.", "Nach dem Umbau meldet der Dienst eine Abweichung, Version v{n}.", "Während der Nachtschicht Uhrendrift, Version v{n}.", "{Noun} {Noun} im Mittel.", "Der Dienst meldet beim {Noun} {Noun}, sonst nichts.", "Es gab nach dem zweiten {Noun} {Noun}.", "Die Anlage zeigte unter hoher {Noun} {Noun}.", "Release Notes for {Product}.", "On Monday, March {d2} the {thing} stopped.", "Open Source Licence text.",
    "See Table {d1} and Figure {d1}.", "{Made} Prime v{n} is out.", "The {Made} {Made} is slow.", "At {Made} {Place} the tide was high.", "{Made}, {Made} and {Made} are products.", "Error Code {d3} in {Product}.", "Pasted Text {d5} here.", "Remove Header {d3} please.", "{given} Airport is shut.", "{given} Street Bridge is shut.",
    "{given} is the name of the new {thing}.", "The {given} cell is idle.", "{Product} {Sys} runs.", "Sensor {d3}-{d2}-{d4} is fine.", "Code {d8}X is a colour.",
    "ssh deploy@node-{d1}.example:~/maps", "The {given} Robotics Company called.", "Docked at Pier {d2}, Row {d1}.", "Team {given} won.", "Between {time} and {time} the greenhouse row had no coverage.", "Frame QQ {d3} {d3} was skipped.", "Offsets 555-{d3} to 555-{d5} are cold.", "{given} Harbour is closed.", "Machine {given} {d2} stopped.", "Author {family} wrote it.", "Bitte {family} neu starten.", "Reporter {family} left.", "Ticket {d10} is open.", "Port {d10} on the hub.", "Window {d3} {d4} in the trace is cold.", "Offsets {d3}-{d4} to {d3}-{d4} are cold.", "Serial {d3}-{d4}.", "Build {d3}-{d3}-{d4} went out.", "two three four retries", "one two three four five tests passed",
)
CARRIERS = (
    "Reporter {person} ({phone}) left {label} {id}.", "{label} {id}, {person}", "{label}: {id} in clear text.", "Remove {label} {id} from the note.", "Form shows {label} {id} in clear text.", "The operator gave {label} {id} for the badge.",
    "Contact card: {person}; {address}; {phone}", "{person} <{email}> lives at {address}", "{person}, {email}, {phone} ext. {d2}", "{person} / {email}", "Signed off by {title}{person}.", "Reviewed with {title}{person} on the call.",
    "Validé par {person} hier.", "Lo confirmó {title}{person} ayer.", "Absprache mit {person} steht noch aus.", "owner: {person}", "according to {person} the map is fine", "{person} will rerun the batch.", "{person} asked to keep it.",
    "Handed over to {title}{person} after the shift.", "{person}'s desk will do it.", "Reviewed with {person}'s desk on the call.", "Call {phone} when it docks.", "Text {phone} if the arm stops.", "tel: {phone}", "Teléfono {phone} para urgencias.",
    "Rückfragen unter {phone}.", "Joindre l'opérateur au {phone}.", "On-call number {phone}.", "Reach the operator at {phone} after hours.", "Reach the operator at {phone} ext. {d2} after hours.", "Write to <{email}>, please.",
    "Escalate via {email}, please.", "reply-to: {email}", "Author {email} pushed it.", "Bitte an {email} melden.", "Écrire à <{email}> en cas de doute.", "Avisar a {email} si falla.", "Send it to mailto:{email}.",
    "Livrer au {address}.", "Lieferung an {address}.", "Enviar a {address}.", "The robot was returned to {address}.", "Ship it to {address}", "{person} called about it.", "Contact {person} about it.", "ask {person} or {person}", "Thanks, {person}", "Kind regards,\n{person}", "Dear {title}{person},", "{title}{person} called.", "It was {person} who stopped the {thing}.", "Met {person}, {person} and {person} at the dock.", "From: {person}", "I spoke to {person} yesterday.", "{person} and {person} agreed.", "Assigned to {person}", "Call {phone} now.", "My number is {phone}.", "{person} – {phone}", "{person} wrote to {person}.",
    "Pasted {label} {id} by mistake.", "On file: {label} {id}.",
)


_HEADS = "al bar cor del em fal gor hal iv jor kel lor mar nor or pel quor ral sil tor ul var wes yor zel".split()
_MIDS = "a e i o u an en ar el ov is or".split()
_TAILS = "ba dan dell fer gard kin lan mer nic ra rik ros sen son ta tov vic wick ya zin".split()


def made(r: random.Random) -> str:
    """A word that is nobody's known name."""
    return (r.choice(_HEADS) + r.choice(_MIDS) + r.choice(_TAILS)).capitalize()


class People:
    """Given and family names, some made up; `lexicons` know none, half and all of them."""

    def __init__(self, seed: int):
        r = random.Random(seed)
        listed = [n.capitalize() for n in sorted(NICKNAMES) + sorted(PLAIN)]
        self.given = listed + [made(r) for _ in range(len(listed) // 3)]
        self.families = FAMILIES + [made(r) for _ in range(3 * len(FAMILIES))]
        half = lambda xs: [x for x in xs if r.random() < 0.5]
        low = lambda xs: [x.lower() for x in xs]
        self.lexicons = [Names(), Names(low(half(self.given)), low(half(self.families))), Names(low(self.given), low(self.families))]


class Writer:
    def __init__(self, people: People, seed: int = 5):
        self.r = random.Random(seed)
        self.people = people

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def person(self) -> str:
        r = self.r
        given, family = r.choice(self.people.given), r.choice(self.people.families)
        first = r.choice([given] * 6 + [f"{given[0]}."] * 3 + [f"{given}-{r.choice(self.people.given)}"])
        middle = r.choice([""] * 6 + [f"{r.choice('ABDHJLMRT')}. "] * 2)
        particle = r.choice([""] * 8 + ["de la ", "van der ", "von ", "al "])
        form = r.choice([f"{first} {middle}{particle}{family}"] * 6 + [f"{family}, {first}", f"{family}, {given} {middle.strip().rstrip('.')}".strip()])
        if given.lower() in PLAIN or given.lower() in NICKNAMES:
            form = r.choice([form] * 12 + [f"{family} {given}"])
            form = form.lower() if r.random() < 0.06 and "." not in form else form
        return form.upper() if r.random() < 0.08 else form.replace(" ", r.choice([" "] * 9 + ["\u00a0", "  "]))

    def phone(self) -> str:
        d, r = self.digits, self.r
        s = r.choice([" ", "-", ".", "\u00a0", "–", " "])
        area, exchange, line = str(r.randint(200, 999)), r.choice(["555", str(r.randint(200, 999))]), d(4)
        spoken = "zero oh one two three four five six seven eight nine".split()
        return r.choice([
            f"+1{s}{area}{s}{exchange}{s}{line}", f"{area}{s}{exchange}{s}{line}", f"({area}) {exchange}-{line}", f"{area}{exchange}{line}", f"+1{area}{exchange}{line}", f"1-{area}-{exchange}-{line}", f"{area}/{exchange}-{line}", f"+44 20 7946 0{d(3)}", f"+44 (0)7700 900 {d(3)}", f"0{r.randint(1, 7)} {d(2)} {d(2)} {d(2)} {d(2)}", f"020 7946 0{d(3)}",
            f"07700 900{d(3)}", f"0{r.randint(1, 7)}{s}{d(2)}{s}{d(2)}{s}{d(2)}{s}{d(2)}", f"+33 6 {d(2)} {d(2)} {d(2)} {d(2)}", f"+49 30 2{d(4)}-{d(3)}", f"030 2{d(4)} {d(3)}", f"0049 171 {d(7)}", f"+34 6{d(2)} {d(3)} {d(3)}", f"{exchange}-{line}",
            r.choice([" ", " ", ", "]).join(r.choice(spoken) for _ in range(r.choice([7, 7, 10, 11]))),
        ])

    def email(self) -> str:
        r = self.r
        given, family = r.choice(self.people.given).lower(), r.choice(self.people.families).lower()
        local = r.choice([f"{given}.{family}", f"{given}_{family}", f"{given[0]}{family}", f"{family}{self.digits(2)}", f"{family}-{given[0]}", f"{given}+agents", f"{given}.{family}+{self.digits(1)}"])
        host = r.choice(HOSTS)
        out = r.choice([f"{local}@{host}"] * 6 + [f"{local} @ {host}", f"{local} at {host.replace('.', ' dot ')}", f"{local} [at] {host.replace('.', ' [dot] ')}", f"{local}(at){host}"])
        return out.upper() if r.random() < 0.1 else out

    def address(self) -> str:
        d, r = self.digits, self.r
        s, t, n = r.choice(STREETS), r.choice(TOWNS), r.randint(1, 240)
        kind = r.choice("Street Road Lane Terrace Court Avenue St. Ave. Ln Blvd Drive".split())
        out = r.choice([
            f"{n} {s} {kind}, {t}", f"{n} {s} {kind}\n{t} ZX{d(1)} {d(1)}QQ", f"Flat {d(1)}, {n} {s} Gardens, {t} ZX{d(1)} {d(1)}QQ", f"P.O. Box {d(3)}, {t}", f"{s}straße {n}, 00{d(3)} {t}", f"{s}weg {n}, {t}", f"{s}str. {n}a, {t}",
            f"Calle {s} {n}, {d(1)}º B, 00{d(3)} {t}", f"Plaza de {s}, {n}, {t}", f"{n} rue de {s}, 00{d(3)} {t}", f"{n} bis, avenue {s}, {t}", f"{n} {s} {kind}, Apt {d(2)}B, {t}, ZZ {d(5)}",
        ])
        return out.upper() if r.random() < 0.1 else out.lower() if r.random() < 0.1 else out

    def identity(self) -> tuple[str, str]:
        d, r = self.digits, self.r
        return r.choice([
            (r.choice(["SSN", "ssn", "social security no.", "SSN#", "social"]), r.choice([f"9{d(2)}-{d(2)}-{d(4)}", f"9{d(2)} {d(2)} {d(4)}", f"9{d(8)}"])), (r.choice(["NINO", "NI number", "National Insurance no."]), r.choice([f"QQ{d(6)}A", f"QQ {d(2)} {d(2)} {d(2)} C"])),
            (r.choice(["DNI", "national id", "identity card", "national identity card"]), r.choice([f"{d(8)}U", f"{d(2)}.{d(3)}.{d(3)}-O"])), (r.choice(["Steuer-ID", "tax identity number", "Steuernummer"]), f"00 {d(3)} {d(3)} {d(3)}"), (r.choice(["NIR", "numéro de sécurité sociale"]), f"2 {d(2)} {d(2)} 00 {d(3)} {d(3)} {d(2)}"), ("taxpayer id", f"9{d(8)}"),
            (r.choice(["driver licence", "driving licence no."]), f"ZZ{d(3)}-{d(4)}-{d(2)}"), (r.choice(["passport", "passport no."]), f"X{d(8)}"),
        ])

    def fill(self, template: str) -> tuple[str, list[tuple[int, int, str]]]:
        r, out, gold = self.r, "", []
        label, identity = self.identity()
        for piece in re.split(r"(\{\w+\})", template):
            key = piece[1:-1] if piece.startswith("{") else None
            if key in ("person", "phone", "email", "address", "id"):
                value = identity if key == "id" else getattr(self, key)()
                gold.append((len(out), len(out) + len(value), "id_number" if key == "id" else key))
                out += value
            elif key is None:
                out += piece
            elif regexp := re.fullmatch(r"d(\d+)", key):
                out += self.digits(int(regexp[1]))
            else:
                out += {
                    "label": label, "title": r.choice(["", "", "Dr. ", "Ms ", "Prof. ", "Mr "]), "thing": r.choice("planner index merger queue bridge decoder".split()), "n": str(r.randint(2, 99_999)), "nn": self.digits(2),
                    "date": f"2025-{r.randint(1, 12):02}-{r.randint(1, 28):02}", "time": f"{r.randint(0, 23):02}:{self.digits(1)}5", "path": "store/tiers.rs", "hex": "%07x" % r.randrange(1 << 28), "Product": r.choice(["Velox", "Tarnix", "Quillon"]),
                    "Town": r.choice(TOWNS), "Sys": r.choice(["Field", "Data", "Sensor"]), "given": r.choice(self.people.given), "family": r.choice(self.people.families), "Made": made(r), "Place": r.choice("Ridge Hill Bay Lake Valley Point".split()), "Noun": r.choice("Messung Ergebnis Neustart Planer Uhrendrift Quittung Frühlauf".split()),
                }[key]
        return out, gold

    def row(self) -> tuple[str, list[tuple[int, int, str]]]:
        r, text, gold = self.r, "", []
        whole = r.random()
        for _ in range(r.randint(1, 4)):
            template = r.choice(r.choice([CARRIERS, CARRIERS, DECOYS, SENTENCES, PROSE, PROSE]))
            part, found = self.fill(template)
            # Headings and shouted notes: capitals everywhere.
            shape = whole if whole < 0.15 else r.random()
            raised = part.upper() if shape < 0.06 else part.title() if shape < 0.12 else part
            part = raised if len(raised) == len(part) else part
            if text:
                text += r.choice([" ", " ", " ", "\n", " | "])
            gold += [(s + len(text), e + len(text), k) for s, e, k in found]
            text += part
        return text, gold


def examples(people: People, rows: int = TRAIN_ROWS, seed: int = 5) -> list[tuple[str, list[tuple[int, int, str]]]]:
    writer = Writer(people, seed)
    return [writer.row() for _ in range(rows)]


def measure(rows: list, names: Names, weights: dict[str, float]) -> tuple[float, float]:
    """(precision, recall) of (kind, start)."""
    hit = found = want = 0
    for text, gold in rows:
        a, b = {(s.kind, s.start) for s in items(text, names, weights)}, {(k, s) for s, _, k in gold}
        hit, found, want = hit + len(a & b), found + len(a), want + len(b)
    return hit / max(1, found), hit / max(1, want)


def main() -> None:
    people, others = People(1), People(2)
    weights = train(examples(people), people.lexicons)
    for name, known in (("no lexicon", others.lexicons[0]), ("half of the names known", others.lexicons[1]), ("all known", others.lexicons[2])):
        print(f"held out, {name}: precision %.4f, recall %.4f" % measure(examples(others, 1_000, 77), known, weights))
    Path(__file__).with_name("pii_weights.json").write_text(json.dumps(weights, indent=0, ensure_ascii=False) + "\n")


if __name__ == "__main__":
    main()
