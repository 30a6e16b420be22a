"""The labelled table that teaches the personal-information tagger.

Sentences with items in ``{braces}``, sentences without, and the public formats of the items (numbering plans, identity documents and postal forms of
several countries, common given names and surnames) are composed by rule and fixed seed into labelled lines. Nothing in it is taken from any corpus:
a text's own wording is met here by accident only, so the tagger has to go by shape, kind of word and neighbours.
"""

from __future__ import annotations

import random
import re

KINDS = ("email", "phone", "id_number", "address", "name")

#: Sentences with items.
WITH = """\
I spoke to {name} about it yesterday.
According to {name}, nothing can be done.
{name} wrote the first version of this guide.
My neighbour {name} lent me hers.
You should talk to {name} from the club.
Is {name} still working there?
Our teacher, {name}, was not amused.
I am {name}, nice to meet you all.
This is {name} speaking.
Contact person: {name}
Posted by {name}
Written by {name} on a train.
The contract was drawn up by {name}.
{name} and {name} split the bill.
it was {name} who found the leak
we went to school with {name}
My cousin {name}, who lives abroad, says the same.
A letter from {name} arrived this morning.
Nobody told {name} that we had left.
She signs as {name}, I believe.
The guitar came from {name} in {month}.
{name}, who runs the {noun} shop, has left town.
{name} and I share a flat.
Try {name} at the front office.
I showed {name} the {noun} and she laughed.
the {noun} was built by {name} years ago
{name} has the keys to the {noun}.
{name} promised to call back.
Does the name {name} mean anything to you?
Please welcome {name} to the group.
Prof. {name} gave the lecture.
Dr {name} looked at it twice.
My dentist is Dr. {name}, and I trust her.
Mrs {name} lives next door.
Ask Mr. {name} or Ms. {name} for the form.
I met Dr. {name}.
Frau {name} und Herr {name} waren nicht da.
Regards, {name}
Kind regards {name}
Sincerely, {name}
Yours truly, {name}
Greetings from {name}
Thank you, {name}
Cheers {name}
Signed: {name}
Name: {name}
~ {name}
* {name}
- {name}
-- {name}
| {name}
{name}
{name}.
{name},
{name} {phone}
{name}, {addr}
{addr}, {name}
{name}, {email}
{name}, {addr}, {phone}
{name}, {id}
Drop me a line: {email}
Questions go to {email} or {email}.
The sender was {email}, I think.
I wrote from {email} and never got a reply.
Use {email} instead of the old one.
email {email} for details
Reply-To: {email}
E-mail: {email}
<{email}>
the list ({email}) is closed
contact: {email}.
My new account is {email}, please update.
Is {email} a known fraud?
Send the {noun} to {email} by {day}.
- {email}
| {email}
{email}
{email},
{phone} or {email}
Phone: {phone}
You have my number: {phone}
His number is {phone}, by the way.
Here is the number I got, {phone}, and nobody answers.
That number, {phone}, is out of service.
The line {phone} was cut off in {month}.
{phone} keeps calling about the {noun}.
Mobile {phone}
Fax: {phone}
T: {phone} M: {phone}
Give me a ring on {phone}.
The office picks up at {phone} until noon.
Somebody called me from {phone} at night.
text {phone} if you are interested
Reach us under {phone}, weekdays only.
You can dial {phone} for help with the {noun}.
is {phone} a scam?
found a {noun}, call {phone}
- {phone}
| {phone}
{phone}
{phone}.
{phone}, {email}
My social security number {id} was stolen.
SSN {id}
SSN: {id}
They typed my SSN wrong: {id}.
NI number {id} was refused by the portal.
The revenue service lists me as {id}.
Tax number: {id}
Passport number {id}, valid for ten years.
My passport ({id}) got lost.
The ID card shows {id} on the back.
My identity card number is {id}.
Health insurance no. {id}
driver's license {id}
His licence number is {id} and it is valid.
My DNI is {id}.
Codice fiscale {id}
Steuer-ID {id}
PESEL: {id}
BSN {id}
NIF {id}
Numéro de sécurité sociale : {id}
T.C. kimlik no {id}
ИНН {id}
Why do they want {id} on every form?
Passport no {id} is mine.
Passport No. {id}
Tax ID {id} is on the envelope.
Licence {id} runs out in {month}.
Their form has {id} as my insurance number.
identity card, no. {id}
They made me write {id}, the number of my identity card, on it.
- {id}
| {id}
{id}
{id}.
Address: {addr}
We moved to {addr} last spring.
The shop is at {addr}, just behind the station.
Deliver the {noun} to {addr}, please.
My grandmother lives at {addr}.
They sent the {noun} to {addr} again.
Visit us: {addr}.
meet me in front of {addr} at noon
The old house at {addr} is for sale.
From {addr} it takes ten minutes.
Billing address {addr}
Mail everything to {addr}
- {addr}
| {addr}
{addr}
{addr}.
{addr},
{addr}, {phone}
Ihr erreicht mich unter {any}.
Meine Daten: {any}.
Joignez-moi ici : {any}.
Mes coordonnées : {any}.
Mi contacto es {any}.
Mis datos: {any}.
Il mio recapito: {any}.
I miei dati: {any}.
Meu contato é {any}.
Os meus dados: {any}.
Je kunt me bereiken via {any}.
Mijn gegevens: {any}.
Mój kontakt to {any}.
Moje dane: {any}.
Bana ulaşmak için: {any}.
Bilgilerim: {any}.
Со мной можно связаться так: {any}.
Мои данные: {any}.
お問い合わせ：{any}
私の連絡方法：{any}。
Ich heiße {name}.
Je m'appelle {name}.
Me llamo {name}.
Mi chiamo {name}.
O meu nome é {name}.
Ik heet {name}.
Nazywam się {name}.
Benim adım {name}.
Меня зовут {name}."""

#: Sentences without items, many of which look as if they had some.
WITHOUT = """\
{given} called and said hello.
My dog {given} ate it.
Ask {given}.
Love, {given}
Thanks {given}!
{given} {initial}. said no.
- {given} {initial}.
{given} and {given} are coming too.
Dr. {given} is what the kids call the robot.
{brand} {noun} review
{Noun} {Noun} by {brand}: worth it?
I prefer the {brand} {Noun} to the {brand} {code}.
the {brand} {code} has a new {noun}
{brand} and {brand} both refused the warranty.
{brand} vs {brand}: which {noun} is better?
{brand} support asked me to wait.
Is {brand} any good for a {noun}?
{brand}, {noun} and {noun}
{brand} {code}: {adj} {noun}
{Adj} {noun} ({brand} {code}) in {month}
The {noun} from {brand} {code} is {adj}.
{noun}: {brand} {code}, any clue?
a {adj} {noun}: {brand} {code}
We call it {brand}. Nobody knows why.
My {noun} is a {brand}. {Noun}s like that are {adj}. So be it.
It is all {brand}. {Noun} or {noun}?
The word is {brand}. Forgive me. The {noun} is {brand}. Perhaps.
PS. {Noun}s are {adj}. P.S. Write soon. NB. Not tested.
Der {brand} und die {brand} passen nicht zum {brand}.
Nach {d2} {brand} war Schluss, und nach {d2} {brand} kam der {brand}.
Mein {brand} ist kaputt, mein {brand} auch. Vielleicht hilft {brand}.
Das {brand} ist {brand}. Wer weiß. Gestern kam das {brand}.
Wer dem {brand} {brand} gibt, wird vom {brand} {brand} bekommen.
Solange die {brand} {brand} hat, ist der {brand} {brand} wert.
El {brand} y la {brand} de los {people}.
Le {brand} et la {brand} sont {brand}. Voilà.
{brand} {brand} {brand} ({brand}) {brand} {d2} {brand}.
{brand} i {brand}. {brand} {brand}, {brand} {brand}.
I bought it from {brand} in {place}.
{brand} ({code}) arrived broken.
{place} is lovely in {month}.
We flew from {place} to {place} on {day}.
The {place} office closed in {month} {year}.
From {place} with love.
We adore {place} in {month}, and {place} too.
Back in {place} it rained. {place} was warm.
{place}, {place} and {place}
Where did I leave the {noun}? What do I need? How am I supposed to know?
What am I doing? Who am I? Should I stay, or am I {adj}? Why do I care?
When I left, I gave the {noun} back. I saw it. Then I went.
What could I have done? Did I break the {noun}? Can I wait?
{people} food is the best.
Los {people}, les {people}, die {people} und the {people} {Noun}
My {people} friends moved to {place}.
The {people} and the {people} signed a treaty.
A {people} family runs the {noun} shop.
Happy {day}! Happy New Year! Merry Christmas!
Will the {noun} last? Mark the date. Rose petals fell. Grace under pressure.
Hope this helps. May I ask why? Frank answers only. Bill the client first. Sue them all.
Art class starts in {month}. Jack of all trades. Pat the dog. Drew a blank. Miles away.
Chase the ball. Penny for your thoughts. Dean of the school. Summer was long.
Serial number {d4}-{d4}-{d4}
Serial {c}{c}{d2}-{d5}-{d3}
Tracking {d4} {d4} {d4} {d4} {d2}
Tracking code {c}{c}{d9}{c}{c} shows nothing.
Invoice {ref} is unpaid.
Invoice no. {ref}, order no. {ref}
My order, {ref}, was delayed by {d2} days.
Order no. {ref} never shipped.
The reference was {ref}, case {ref}.
Ticket no. {ref}? Model no. {ref}!
Serial no. {ref} and part no. {ref}
Order #{d7} was cancelled.
Ticket {d3}-{d4} is closed.
Case no. {d2}-{d3}-{d4}
Episode {d3}, round no. {d4}
Open thread no. {d5}
Monthly chat #{d5}, {month} edition
Day #{d3}, question #{d5}, #{d4} and #{d2}
Big {noun} thread #{d5}
Poll no. {d4}: {noun} or {noun}?
A friend of mine laughed. A woman at the counter said no. A man I know left.
The {noun} here ({brand} {code}) stays {adj}; what now?
{Adj} {noun} ({brand}) went {adj} by {month}: any help?
@admins please look
Hey @everyone and @{brand}, see above.
ISBN 978-{d1}-{d3}-{d5}-{d1}
Part {c}{c}-{d4} or {c}{d3}{c}
Model {c}{d3}, firmware {d1}.{d2}.{d3}
Version {d1}.{d1}.{d2} and {d2}.{d1} both crash.
ping {d3}.{d2}.{d1}.{d3} fails
{d2}:{d2}:{d2} elapsed, {d3} errors
The date was {date}, at {d2}:{d2}.
Due {date}, paid {date}
Published {date}. Last change: {date}
{date}
{d2}/{d2}/{year} or {d2}.{d2}.{year}
It cost ${d2},{d3}.{d2}, or {d3} euros.
{d1},{d3},{d3} people saw it.
between {d3}-{d3} and {d4}-{d4} watts
{d1}-{d1}-{d1}, then {d2}-{d2}
Countdown: {d1}-{d1}-{d1}-{d1}
{d1}-{d1}-{d1}-{d1}-{d1}
{d1}, {d1}, {d1}-{d1}-{d1}-{d1}-{d1}-{d1}
I mark every page. I jack the car up. I bill by the hour. I drew a rose. I frank the letters.
I re-tie, I co-sign, I half-sleep. A well-kept {noun}, a sugar-free one.
[{Noun}] [{noun}] {Noun} {noun}
[{noun}] {Adj} {noun}? [{Noun}]
{d2}-{d2}-{d2}-{d1} {d1}.{d1}.{d1}.{d1}
{d2} x {d2} x {d3} cm, {d1}.{d1} kg
1/{d3} s at f/{d1}, ISO {d3}
+{d2} points, -{d1} lives
{d4} rpm in {d1}. gear
Chapter {d2}, page {d3}, line {d1}
In {year} there were {d5} of them.
Room {d3}, floor {d1}, box {d2}, unit {d1}
{d2} streets further, take road {d1} and then a lane.
Drive slowly, the court is closed and so is the way to the park.
{d2} ways to place a {noun} in a square room
A street fair, a road trip, an avenue of trees, a lane change.
Lane {d1} was free, so we took road {d2} to {place}.
The {Noun} Road is closed for {d2} days.
We sat in Court {d1} for {d2} minutes.
user {given}{d2} posted again
u/{given}{d2} and r/{noun}s
Follow @{brand} or #{noun}
@{given}{d2} thanks
admin@localhost and root@{noun}
meet at six, dot the i
look at this dot on the map
https://{brand}.com/{noun}/{d5}?id={d4}
www.{brand}.net/{noun}
{noun}_{d2}.png and {Noun}{Noun}.java
for i in range({d2}): x[{d1}] = {d3}
Edit {d1}: forgot the {noun}.
Part {d1} of {d2}: The {Noun}
[Tag] {Noun} {code}
{code} {code} {code}
{Noun}: {noun}, {noun} and {noun}
The {Adj} {Noun} and the {Adj} {Noun}
{Adj} {Noun} {Noun} in {place}
{Adj} {noun}, {adj} {noun}, {adj} {noun}
a {adj} {noun} wants a {adj} {noun} within {d2} days
After {d2} weeks the {noun} was {adj}.
Is a {adj} {noun} normal? The {noun} is {adj}.
I tried {d2} {noun}s and {d1} of them were {adj}.
Clean the {noun} before you dry the {noun}, and wait {d2} hours.
Every {day} the {noun} gets {adj} and the {noun} too.
A week ago the {noun} worked; now my {noun} is {adj}.
You are {adj}, and your {noun} is {adj} as well.
Nobody likes a {adj} {noun}, honestly. Get over it.
Good news: the {noun} works. Thanks, everyone.
My typing is bad, please excuse it. Spelling was never a strength.
Tell me. Take care. See you on {day}.
Great Expectations, War and Peace, Star Wars, Harry Potter
General Motors, Silicon Valley, Wall Street, Central Park
Machine Learning, Quality Control, Customer Service, Human Resources
Operating System, User Manual, Power Button, Safety First
Der Motor und die Batterie sind alt. Das Haus am See ist groß.
Mein Fahrrad ist {adj}, das Auto von {brand} auch.
Die Firma {brand} hat das Werk in {place} geschlossen.
Seit {d2} Tagen macht der Drucker ({brand} {code}) Lärm.
La maison ({brand}) est fermée depuis {d2} jours.
Hace {d2} días que el coche de {brand} no arranca.
Il treno da {place} ha {d2} minuti di ritardo.
Há {d2} dias que a máquina ({brand}) não liga.
De fiets van {brand} is al {d2} dagen kapot.
Rower marki {brand} stoi od {d2} dni.
{brand} marka bisiklet {d2} gündür bozuk.
Велосипед {brand} сломан уже {d2} дней.
{brand}の自転車は{d2}日前から動きません。
この時計は{d2}週間前から遅れています。理由を知りたいです。{d2}回直しました。
庭の花（{brand}）が{d1}か月前から咲きません。
{d2}年前に買った車です。{d1}時に駅で会いましょう。
古い窓が{d2}週間前から開きません（{brand}）。どうすればいいですか。
電車の中でこの本を読みました。とても面白かったです。"""

#: Common given names of several countries.
GIVEN = """Ada Adam Agnes Ahmed Aisha Aiko Alan Albert Alejandro Alessandro Alex Alice Amara Amelia Amina Amy Ana Anders Andrea Andrew Anna Anne Antonio Arthur Astrid Ayşe Barbara Beatriz Ben Benjamin Benoît Bernd Björn Boris Brian Bruno
Callum Camille Carla Carlos Catherine Charles Charlotte Chiara Chloé Christian Clara Claire Claudia Daniel David Diana Diego Dieter Dmitri Dorothy Edward Elena Elif Elisabeth Emil Emily Emma Eric Erik Eva Fatima Felix Fernando Fiona
Francesca François Franz Fritz Gabriel Georg George Giovanni Giulia Grace Greta Gustav Hana Hannah Hans Hassan Heidi Helen Henry Hiroshi Hugo Igor Ines Ingrid Irina Isabel Ivan Jack Jakub James Jan Jana Jane Jean Jennifer Jessica João
John Jonas José Joseph Juan Julia Julien Karen Karin Karl Katarzyna Keiko Kenji Kevin Klaus Lars Laura Lena Leo Linda Lisa Louis Lucas Lucía Luigi Luis Magda Manuel Marco Margaret Maria Marie Mario Mark Marta Martin Mary Mateo Matthew
Mehmet Mia Michael Miguel Mikhail Mohammed Monika Nadia Natalia Nicolas Nina Noah Olga Oliver Olivia Omar Oscar Otto Paolo Patricia Paul Paula Pedro Peter Philip Pierre Piotr Priya Rachel Rafael Raj Rebecca Richard Robert Rosa Ruth
Samuel Sara Sasha Sergei Simon Siobhan Sofia Sophie Søren Stefan Susan Sven Tatiana Thomas Tomasz Ursula Valentina Vera Victor Viktor Vladimir Walter William Wolfgang Yara Yuki Yusuf Zoë""".split()  # fmt: skip
#: Common surnames of several countries; as many more are made by rule.
SURNAMES = """Smith Jones Taylor Brown Wilson Evans Thomas Johnson Roberts Walker Wright Thompson White Hughes Edwards Green Hall Wood Harris Clarke O'Brien Murphy Kelly Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Hoffmann Schulz
Martin Bernard Dubois Laurent Lefebvre Moreau Fournier García Fernández González Rodríguez López Sánchez Pérez Gómez Silva Santos Ferreira Pereira Oliveira Costa Rossi Russo Ferrari Esposito Bianchi Romano Jansen Bakker Visser Smit Mulder
Nowak Kowalski Wiśniewski Zieliński Yılmaz Kaya Demir Çelik Ivanov Petrov Sokolov Volkov Tanaka Suzuki Sato Watanabe Hansen Nielsen Larsen Johansson Lindberg Berg Novák Horvat Popescu Singh Patel Kumar Nguyen Chen Kim""".split()  # fmt: skip
#: Words that make up streets, by form.
ROADS = "Street St St. Road Rd Rd. Avenue Ave Ave. Lane Ln Drive Dr Close Court Ct Boulevard Blvd Way Place Pl Square Sq Terrace Crescent Row Parkway".split()
ROAD_NAMES = "Elm Ash Willow Birch Linden Rosewood Victoria Albert Queen's Prince Abbey Castle Garden Forest Lake Harbour Market College Chapel Windmill Meadow Spring Hillside Sunset Washington Lincoln Broad Long Upper Lower North South Kings Temple Bishop Fountain".split() + ["Old Mill", "White Horse", "St Mary's", "Black Bridge", "Three Oaks", "New Dock"]
FOREIGN_ROADS = {
    "de": ("Hauptstraße;Bahnhofstraße;Gartenweg;Schulgasse;Bergallee;Ringstr.;Mühlweg;Kirchplatz;Am Markt;An der Mühle;Im Winkel;Am Bahnhof", "{road} {n}"), "fr": ("rue de la Gare;rue Victor Hugo;avenue de la République;boulevard Voltaire;chemin du Moulin;place du Marché;impasse des Lilas", "{n} {road}"),
    "es": ("Calle Mayor;C/ Sol;Avenida de la Paz;Plaza Nueva;Paseo del Prado;Calle de Alcalá", "{road} {n}"), "it": ("Via Roma;Via Garibaldi;Viale Europa;Piazza Dante;Corso Italia;Vicolo Stretto", "{road} {n}"),
    "pt": ("Rua Direita;Rua das Flores;Avenida da Liberdade;Largo do Carmo;Travessa Nova", "{road}, {n}"), "nl": ("Kerkstraat Dorpsstraat Molenweg Stationsplein Prinsengracht Havenkade Lindelaan", "{road} {n}"),
    "pl": ("ul. Polna;ul. Leśna;Aleja Wolności;ulica Długa;plac Zamkowy", "{road} {n}"), "tr": ("Atatürk Caddesi;Gül Sokak;Lale Sokağı;İnönü Bulvarı", "{road} No: {n}"), "ru": ("ул. Ленина;улица Мира;проспект Победы;Садовая ул.", "{road}, д. {n}"),
}
TOWNS = "London Leeds Bristol Oxford Dublin Boston Denver Austin Portland Chicago Toronto Berlin Hamburg München Wien Paris Lyon Madrid Sevilla Roma Milano Lisboa Porto Amsterdam Utrecht Warszawa Kraków Istanbul Москва Springfield Riverside Greenville".split()
PLACES = "San Francisco,New York,Los Angeles,Santa Cruz,Hong Kong,Buenos Aires,South Africa,New Zealand,Puerto Rico,Great Britain,Tokyo,Paris,Berlin,Rome,Cape Town,Lake Como,Mount Fuji,Grand Canyon,Saint Petersburg".split(",")
PEOPLES = "French,German,Italian,Turkish,Polish,Russian,Dutch,Spanish,Roman,Persian,Jewish,Muslim,Christian,African".split(",")
NOUNS = "printer kettle bicycle novel guitar oven garden lamp camera phone laptop ladder chair window engine battery mirror ticket recipe carpet blanket violin piano battery bridge river mountain budget contract exam lecture password screen keyboard router tablet pump filter valve mattress fridge cat horse tree rose soup bread salad ring coat boot tent boat train bus plane".split()
ADJECTIVES = "old new broken noisy cheap quiet heavy slow loud small green wooden electric strange wet dry empty dirty stupid lazy ugly smart friendly famous".split()
DAYS = "Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split()
MONTHS = "January February March April May June July August September October November December".split()
#: Domains of mail addresses; those reserved for examples, and common endings.
DOMAINS = "example.com example.net example.org mail.example.com test.example post.example localmail.test webpost.invalid".split()
ENDINGS = "com net org de fr es it pt nl pl ru co.uk info example test invalid".split()
SYLLABLES = "ba be bri cor dal den dor el fa fen gar gor hal hes in jo ka kel lan lor ma mer mi nar nor ol pe pra quin ra ros sa sel sto ta tor ul va vel wen yor za zel".split()
SURNAME_ENDS = "son man berg er ley ton ski ska ov ova in ez es i o eau ard sen stein feld mann dahl qvist ström strom oğlu vic ic ini elli ham well field worth by ford wood".split()


#: What stands around an item in sentences made of random words: {w} is any word, {W} one with a capital, {item} the item.
AROUND = """\
{W} {w} {w} {item} {w} {w}.
{W} {w} {w} {w} {item}.
{w} {w} {item} {w} {w} {w}
{w} {w} {w} {item}
{item} {w} {w} {w} {w}.
{item} {w} {item} {w} {w} {w}.
{W} {w}, {item}, {w} {w}.
{W} {w} ({item}) {w} {w}.
{W} {w} {w}: {item}.
{W}: {item}
{W} {item} {w} {w}?
{W} {w} {w} {item}, {w} {w} {w}?
{W} {w}? {item} {w}
{W} {w} {w} {w} {item} {w} {day}.
{W} {w} {Noun} {item} {w}.""".split("\n")
#: Sentences of random words without items: {b} is a made-up word.
PLAIN = """\
{W} {w} {w}, {w} {w}. I {w} {w} {w}.
I {w} {w}, and I {w} {w} {w}.
{b} {w} {w} {w}.
{w} {w}. {b} {w} {w}
{W} {b} {w} {w} {b}, {w}?
{w} {b}, {w} {b} {w}.
{W} {w} {B} {w} {w} {B} {w}.
{W} {w}: I {w} {w}
{B} {b} {w} {w}, {b} {w}.
{b} {b} {b} {w} {b}, {b} {b}.
{e} {w} {w} {e}{e}
{W} {w} {date} {w} {w}.
{w} {w} {w} {date}.
{W} {d2}:{d2} {w}, {date}: {w} {w}
{W} {w} {w} {e} {w}
{W} {w} {d1}: I {w} {w} {w}.""".split("\n")
SYMBOLS = ["🙂", "🎉", "🚗", "❤️", "👍🏽", "👨‍👩‍👧", "…", "→", "★", "***", "~~", "\u200b", "^^", "<3", ":-)", "&amp;", "&#40;"]
COUNTRY_CODES = "1 31 32 33 34 351 353 39 41 43 44 45 46 47 48 49 7 81 86 90 91".split()


class Maker:
    """Draws items and fillers from one seeded source."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.invented_words: set[str] = set()  # of brands and peoples, which are no items
        self.invented_given: set[str] = set()

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def letter(self) -> str:
        return self.r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ")

    def form(self, pattern: str) -> str:
        """A number after its public form: # is a digit, ^ one from 1 to 9, @ a letter."""
        return "".join(self.digits(1) if c == "#" else self.r.choice("123456789") if c == "^" else self.letter() if c == "@" else c for c in pattern)

    def invented(self, least: int = 2, most: int = 3) -> str:
        return "".join(self.r.choice(SYLLABLES) for _ in range(self.r.randint(least, most))).capitalize()

    def given(self) -> str:
        if self.r.random() < 0.6:
            return self.r.choice(GIVEN)
        name = self.invented(1, 3)
        self.invented_given.add(name.lower())
        return name

    def surname(self) -> str:
        x = self.r.random()
        one = self.r.choice(SURNAMES) if x < 0.35 else self.invented(1, 2) + self.r.choice(SURNAME_ENDS)
        if x > 0.95:
            return f"{one}-{self.surname()}"
        return f"{self.r.choice(['de', 'van', 'von', 'Mc', 'Di'])} {one}".replace("Mc ", "Mc") if x > 0.91 else one

    def case(self, text: str, upper: float, lower: float) -> str:
        x = self.r.random()
        return text.upper() if x < upper else text.lower() if x < upper + lower else text

    def name(self) -> str:
        known, last = self.given(), self.surname()
        form = self.r.choice(["{g} {l}"] * 10 + ["{l}, {g}"] * 4 + ["{i}. {l}"] * 5 + ["{g} {m}. {l}", "{g} {m}. {l}", "{g} {h} {l}", "{l}, {i}."])
        text = form.format(g=known, l=last, i=known[0], m=self.letter(), h=self.r.choice(GIVEN))
        return text if "." in text else self.case(text, 0.07, 0.05 if "," in text else 0.16)

    def email(self) -> str:
        a, b = (x.lower().replace(" ", "").replace("'", "") for x in (self.r.choice(GIVEN), self.surname()))
        if self.r.random() < 0.85:
            a, b = (x.translate(str.maketrans("äöüáéíóúãçñøåßşğıçëïîôê", "aouaeiouacnoassgiceiioe")) for x in (a, b))
        n = self.digits(self.r.randint(1, 4))
        local = self.r.choice([f"{a}.{b}", f"{a}_{b}", f"{a}-{b}", f"{a[0]}{b}", f"{a}{n}", f"{b}{n}", f"{a}.{b}{n}", f"{a}+news", f"{a}_{b}{n}", f"{a[0]}.{b}", self.invented().lower(), f"info.{b}"])
        host = self.r.choice(DOMAINS) if self.r.random() < 0.4 else f"{self.invented().lower()}.{self.r.choice(ENDINGS)}"
        if self.r.random() < 0.2:
            host = f"{self.r.choice(['mail', 'post', 'web', 'smtp'])}.{host}"
        dotted, square, round_ = host.replace(".", " dot "), host.replace(".", "[dot]"), host.replace(".", "(dot)")
        text = self.r.choice([f"{local}@{host}"] * 9 + [f"{local} @ {host}", f"{local}＠{host}", f"{local}(at){host}", f"{local} (at) {host}", f"{local}[at]{host}", f"{local}[at]{square}", f"{local}(at){round_}", f"{local} at {dotted}", f"{local} at {dotted}", f"{local} AT {host.replace('.', ' DOT ')}"])
        return self.case(text, 0.08, 0)

    #: Forms of telephone numbers of several countries.
    PHONES = """^##-^##-####|^##-^##-####|^##-^##-####|^##.^##.####|(^##) ^##-####|(^##)^##-####|^##.^##.####|1^##^######|1^##^######|1^##^######|1-^##-^##-####|+1 ^## ^## ####|+1-^##-^##-####|+1 (^##) ^##-####|^## ^## ####|^## ####
07### ######|07### ### ###|0^## ### ####|0^### ######|0^## ########|0^# #### ####|020 #### ####|(0^##) ### ####|(0^###) ######|0^##-### ####|+44 ^### ######|+44 (0)^### ######|+44 (0)7### ###-###|+44^#########|+447#########|0044 ^### ######
0^## ######|0^##/#######|0^#-#######|0^# ##### ###|0^#/########|+49 ^## #######|+49 (0)^##/#######|+49 (0)^##-######|+49^##########|0049 ^## #######|0049 ^# ########|01## #######|0^ ## ## ## ##|0# ## ## ## ##|0#.##.##.##.##|0^.##.##.##.##|0^-##-##-##-##|+33 ^ ## ## ## ##|+33 (0)^ ## ## ## ##|0033 ^ ## ## ## ##
^## ### ###|^## ## ## ##|+34 ^## ### ###|+34 ^########|+39 ^## ### ####|3## #######|+351 ^## ### ###|06-########|06 ########|0^#-### ####|+31 6 ########|+31 (0)6-########|+48 ^## ### ###|+48^########|0(^##) ### ## ##|+90 ^## ### ## ##|0^## ### ## ##|+7 ^## ###-##-##|8 (^##) ###-##-##|+7 (^##) ### ## ##|0^#-####-####|0^0-####-####|+81 ^# #### ####""".replace("\n", "|").split("|")
    #: Forms of identity, insurance and tax numbers of several countries.
    IDS = """###-##-####|### ## ####|###-##-####|9##-##-####|@@ ## ## ## @|@@######@|@@ ######@|@@ ## ## ## @|########@|########-@|@#######@|@-#######-@|@########|@@#######|@######|@@######|@## ######|## ### ### ###|## ### ### ###|### ### ###|###########|##########|@##@####@|@##@##@###|@@@######|@@@@@@##@##@###@
# ## ## ## ### ### ##|###.###.###-##|########-####|######-####|######-#####|#### #### ####|@@@@@####@|@#########|@@@ ######|## ##### ##|@@#####@@|###/###/###|@###-####-####-##""".replace("\n", "|").split("|")

    def phone(self) -> str:
        text = self.form(self.r.choice(self.PHONES))
        if self.r.random() < 0.25:  # digits in any groups behind a country code or a zero
            groups = " ".join(self.digits(self.r.choice([2, 2, 3, 3, 4])) for _ in range(self.r.choice([3, 3, 4])))
            text = self.r.choice(["+{} ", "+{}", "00{} ", "+{} (0)"]).format(self.r.choice(COUNTRY_CODES)) + groups if self.r.random() < 0.6 else f"0{groups}"
            text = text.replace(" ", self.r.choice([" ", " ", " ", "-", ".", ""])) if text[0] != "+" else text
        return text + self.r.choice([f" ext. {self.digits(2)}", f" x{self.digits(3)}", f" ext {self.digits(3)}"]) if text[0] in "(123456789" and self.r.random() < 0.15 else text

    def id(self) -> str:
        return self.form(self.r.choice(self.IDS))

    def code(self) -> str:
        """A postal code."""
        return self.form(self.r.choice(["#####", "#####", "@@# #@@", "@## #@@", "@# #@@", "@@## #@@", "#### @@", "##-###", "####-###", "@@ #####", "######"]))

    def addr(self) -> str:
        r, town = self.r, self.r.choice(TOWNS) if self.r.random() < 0.5 else self.invented() + self.r.choice(["", "ton", "ville", "burg", "dorf", "field", "port", "haven"])
        n, x = str(r.choice([r.randint(1, 99), r.randint(1, 300), r.randint(1, 2999)])) + (r.choice("abcd") if r.random() < 0.18 else ""), r.random()
        tail = r.choice(["", "", "", "", f", {town}", f", {town} {self.code()}", f", {town}, {self.code()}", f", {self.code()} {town}", f" {self.code()} {town}"])
        if x < 0.5:
            name = r.choice(ROAD_NAMES) if r.random() < 0.5 else self.invented() + r.choice(["", "", "'s", " Hill", " Mill", " Park"])
            side = r.choice(["", "", "", "", f"{r.choice('NSEW')}. ", f"{r.choice(['North', 'West'])} ", "Old ", "New "])
            unit = r.choice(["", "", "", f", Apt {r.randint(1, 40)}", f", Apt. {r.randint(1, 40)}", f", Flat {r.randint(1, 20)}", f", Unit {r.randint(1, 20)}", f" #{r.randint(1, 99)}", f", Suite {r.randint(1, 400)}", f" Apt {r.randint(1, 40)}{self.letter()}"])
            text = r.choice([f"{n} {side}{name} {r.choice(ROADS)}{unit}{tail}"] * 7 + [f"Flat {r.randint(1, 20)}, {n} {name} {r.choice(ROADS)}{tail}", f"{name} {r.choice(ROADS)} {n}{tail}", f"{name} {r.choice(ROADS)} #{n}{tail}"])
        elif x < 0.62:
            text = f"{r.choice(['P.O. Box', 'PO Box', 'P. O. Box', 'POB', 'P.O. box', 'Box', 'Postfach', 'Apartado', 'Postbus', 'BP'])} {r.randint(10, 99999)}{tail or f', {town}'}"
        else:
            roads, form = FOREIGN_ROADS[r.choice(sorted(FOREIGN_ROADS))]
            road = r.choice(roads.split(";") if ";" in roads else roads.split())
            if r.random() < 0.35:  # the same form with a road of another name
                first, *rest = road.split(" ")
                road = " ".join([first, *rest[:-1], self.invented()]) if rest else self.invented() + r.choice(["straße", "weg", "gasse", "allee", "straat", "laan", "platz", "plein"])
            if form == "{n} {road}" and r.random() < 0.35:
                form = "{n}, {road}"
            text = form.format(road=road, n=n + r.choice(["", "", "", f"/{r.randint(1, 9)}", f", {r.randint(1, 9)}º {r.choice('ABC')}", f" bis, app. {r.randint(1, 9)}"])) + tail
        return self.case(text, 0.03, 0.2)

    def date(self) -> str:
        year, month, day = self.r.randint(1960, 2035), self.r.randint(1, 12), self.r.randint(1, 28)
        form = self.r.choice(["{y}-{m:02d}-{d:02d}", "{y}-{m:02d}-{d:02d}", "{d:02d}.{m:02d}.{y}", "{d}.{m}.{y}", "{m:02d}/{d:02d}/{y}", "{d}/{m}/{y}", "{d:02d}-{m:02d}-{y}", "{y}/{m:02d}/{d:02d}", "{y}{m:02d}{d:02d}"])
        return form.format(y=year, m=month, d=day)

    def filler(self, what: str) -> str:
        r = self.r
        if what[0] == "d" and what[1:].isdigit():
            return self.digits(int(what[1:]))
        table = {
            "noun": lambda: r.choice(NOUNS), "Noun": lambda: r.choice(NOUNS).capitalize(), "adj": lambda: r.choice(ADJECTIVES), "Adj": lambda: r.choice(ADJECTIVES).capitalize(), "day": lambda: r.choice(DAYS), "month": lambda: r.choice(MONTHS),
            "year": lambda: str(r.randint(1850, 2030)), "place": lambda: r.choice(PLACES), "people": lambda: r.choice(PEOPLES) if r.random() < 0.5 else self.invented() + r.choice(["i", "s", "ish", "ans", ""]), "given": lambda: r.choice(GIVEN), "initial": self.letter, "c": self.letter,
            "brand": lambda: self.invented() + r.choice(["", "", "ex", "tech", "ia", "on"]), "date": self.date, "ref": lambda: r.choice("-- /").join(self.digits(n) for n in r.choice([(4, 2, 4), (4, 4), (2, 5, 3), (5, 2), (2, 4), (4, 4, 4), (5, 5), (2, 2, 5), (6, 4), (4, 3, 3), (3, 7, 7), (2, 6)])), "code": lambda: self.form(r.choice(["@##", "@###", "@@##", "@##0", "##@", "@#", "@@###", "@-###"])),
        }
        word = table[what]()
        if what in ("brand", "people"):
            self.invented_words.add(word.lower())
        return word

    def nothing(self, words: list[str]) -> tuple[str, list[tuple[int, int, str]]]:
        """Sentences of random words and made-up ones, without items."""
        line = self.r.choice(PLAIN)
        while "{e}" in line:
            line = line.replace("{e}", self.r.choice(SYMBOLS), 1)
        for slot in ("{w}", "{W}", "{b}", "{B}"):
            while slot in line:
                word = self.r.choice(words) if slot in "{w}{W}" else self.filler("brand").lower()
                line = line.replace(slot, word.capitalize() if slot in "{W}{B}" else word, 1)
        return self.fill(line)

    def around(self, words: list[str]) -> tuple[str, list[tuple[int, int, str]]]:
        """A sentence of random words around items."""
        kind = self.r.choice(["name", "name", "name", "email", "phone", "phone", "id", "addr", "addr", "addr"])
        line = self.r.choice(AROUND).replace("{item}", "{" + kind + "}")
        while "{w}" in line or "{W}" in line:
            line = line.replace("{w}", self.r.choice(words), 1)
            line = line.replace("{W}", self.r.choice(words).capitalize(), 1)
        return self.fill(line)

    def fill(self, line: str) -> tuple[str, list[tuple[int, int, str]]]:
        """Text of a line and its items (start, end, kind)."""
        text, items, at = "", [], 0
        while (a := line.find("{", at)) >= 0:
            b = line.index("}", a)
            what = line[a + 1 : b]
            text += line[at:a]
            if what == "any":
                what = self.r.choice(["email", "phone", "id", "addr", "name"])
            if what in ("name", "email", "phone", "id", "addr"):
                item = getattr(self, what)()
                items.append((len(text), len(text) + len(item), {"id": "id_number", "addr": "address"}.get(what, what)))
            else:
                item = self.filler(what)
            text += item
            at = b + 1
        return text + line[at:], items


def template_words() -> list[str]:
    """The words of the language that the table is made of, without the items."""
    return [re.sub(r"\{\w+\}", " ", text) for text in (WITH, WITHOUT)] + [" ".join(x) for x in (NOUNS, ADJECTIVES, DAYS, MONTHS)]


def labelled_lines(number: int = 20000, seed: int = 11, more_without: list[str] | None = None) -> tuple[list[tuple[str, list[tuple[int, int, str]]]], set[str], set[str]]:
    """``number`` labelled lines: one to four of the sentences above, in any order, set apart in the ways in which people do; and the made-up words that are no items, and those that are given names."""
    maker = Maker(seed)
    with_items, without = WITH.split("\n"), WITHOUT.split("\n")
    more = more_without or [line for line in without if "{" not in line]
    words = re.findall(r"[^\W\d_]+", " ".join([*more, *NOUNS, *ADJECTIVES, re.sub(r"\{\w+\}", " ", WITHOUT)]).lower())
    bare = [line for line in with_items if len(line) - line.rindex("}") <= 2 and line.index("{") <= 3]
    out = []
    for i in range(number):
        picks = [maker.r.choice([with_items, bare, without, without, more, None, None, None, ""]) for _ in range(maker.r.choice([1, 2, 2, 3, 3, 4]))]
        parts = [maker.fill(maker.r.choice(lines)) if lines else maker.around(words) if lines is None else maker.nothing(words) for lines in picks]
        if i < len(with_items):
            parts[0] = maker.fill(with_items[i])
        elif i < len(with_items) + len(without):
            parts[0] = maker.fill(without[i - len(with_items)])
        change = maker.r.random()
        if change < 0.24:  # lines without items also in capitals or with capitals
            parts = [(part if found else part.title() if change < 0.12 else part.upper() if change < 0.18 else part.lower(), found) for part, found in parts]
        text, items = "", []
        for part, found in parts:
            if text:
                text += maker.r.choice([" ", " ", " ", " ", " ", " | ", " - ", " -- ", " / ", " * "])
            items += [(a + len(text), b + len(text), k) for a, b, k in found]
            text += part
        out.append((text, items))
    return out, maker.invented_words, maker.invented_given
