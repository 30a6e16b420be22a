"""Hand-written sentences with items in [brackets] of a kind, none of them composed by the rules that teach the tagger."""

NAME = """\
Yesterday evening [Margaret Thornbury] dropped by with a cake.
Do you remember [Dmitri Volkov] from third grade?
The award went to [Olga Marchenko] this time.
My roommate [Tyler Beaumont] plays drums at midnight.
In the end [Sophie Lindqvist] fixed everything herself.
A plumber called [Graham Pickering] fixed our sink.
I inherited it from [Eleanor Fitzgerald], my great aunt.
Prof. [Hiroshi Nakamura] wrote the textbook.
Our midwife was [Ingrid Halvorsen].
Do not trust [Viktor Petrenko], he never pays.
Mr. [Alan Whitcombe] owns the garage downstairs.
Best wishes, [Rachel Goldberg]
[Johnson, Michael] is next on the list.
the lawyer, [P. Ashworth], charged us twice
we hired [Carlos Mendoza] to paint the fence
The referee, [Luca Moretti], saw nothing.
[William H. Carter] signed the lease.
[Anna Kowalczyk] and [Piotr Zielinski] got married.
Hi, [Fiona MacLeod] here, new member.
Somebody named [Kevin O'Connor] replied first."""

EMAIL = """\
You may write to [jane.doe@corp.com] any time.
Invoices: [billing@smallshop.co.uk]
My old address [t.smith_88@mailbox.org] bounces.
Please forward this to [hr-team@university.edu] today.
Spam from [winner2024@lottery.ru] again!
cc [m.garcia@empresa.es] and [lea.dupont@societe.fr]
[support@gadgetworld.de] never answers
reach out: [peter.pan (at) neverland.org]
i am [lonelyplanet99 at gmail dot com] if you care
Mein Postfach: [hans.huber@posteo.at]
[K.Lee@Example.COM]
feedback to [noreply@forum.io] is pointless"""

PHONE = """\
Please dial [0161 496 0753] before ten.
My cell is [(415) 867-5309], leave a voicemail.
Hotline [+49 30 901820] is always busy.
Try [+33 1 42 68 53 00] for the embassy.
Emergency plumber: [020 7946 0321]
The number [212-664-7665] no longer works.
Got three missed calls from [+44 7911 123456] today.
Rufen Sie bitte [089/1234567] an.
Appelez le [04 91 13 89 00] avant midi.
You can WhatsApp me at [+34 612 345 678].
[555.867.5309] rings forever
the landlord answers at [07911 123 456] only
for tickets ring [+1 (646) 555-0142]
home phone [703-555-0188]"""

ID_NUMBER = """\
She shouted SSN [219-09-9999] across the bus.
Is it bad that my SSN [078-05-1120] is on the web?
My NI number is [QQ 12 34 56 C] according to HMRC.
Passport [C01X00T47] expires in June.
The passport number [533380006] was misread.
DNI [12345678Z] and nothing else.
NIE [X1234567L] took months.
Steuer-ID [12 345 678 901] fehlt auf dem Formular.
The tax number [86095742719] is wrong.
Codice fiscale [RSSMRA85T10A562S] rejected.
PESEL [44051401359] is required.
My driver's license [D1234567] was confiscated.
Insurance number [65 180539 W 001] got printed.
They have my social security number, [457-55-5462], on file."""

ADDRESS = """\
Come to [7 Rue de Rivoli, 75004 Paris] on Sunday.
We rent a flat at [221B Baker Street, London NW1 6XE].
Parcels go to [1600 Pennsylvania Avenue, Washington].
Her new place is [48 Chestnut Lane, Apt 5].
The party is at [12 Harbour Road, Brighton] tonight.
Ich wohne in der [Lindenstraße 14, 10969 Berlin].
Send the keys to [P.O. Box 1234, Springfield].
our office: [350 Fifth Avenue, New York, 10118]
The clinic moved to [9 Mill Court] last year.
Il magasin est au [25 avenue Foch, 69006 Lyon].
Abito in [Via Verdi 8, 20121 Milano].
the fire was at [83 kings road] around noon
[77 Sunset Blvd, Los Angeles 90028]"""

NOTHING = """\
We love San Francisco in the fall.
My Galaxy Ultra died after two years.
The Grand Budapest Hotel is a great film.
Windows 11 build 22621.1105 crashes on boot.
Order 114-3941689-8772232 never shipped.
The score was 21-14, 18-21, 21-19.
ISBN 0-306-40615-2 is out of print.
Flight LH1234 leaves at 14:35 from gate B12.
Set the oven to 180 degrees for 45 minutes.
Add 2,500.00 to row 17 of sheet 3.
New York Times best sellers bore me.
Open port 8080 on 192.168.1.254 first.
Sarah left early and Tom stayed.
Tomorrow is Friday the 13th of October 2023.
See chapter 4, section 2.1, page 118.
Turn left at the street with the old court.
@travelbug posted a picture on Instagram.
The Ford Mustang GT beats the Toyota Supra.
Mix 3 cups of flour, 2 eggs and 1/2 tsp salt.
He ran 42.195 km in 3:59:58."""

CASES = {"name": NAME, "email": EMAIL, "phone": PHONE, "id_number": ID_NUMBER, "address": ADDRESS}


def read(line: str) -> tuple[str, list[tuple[int, int]]]:
    """Text of a line without its brackets, and where its items lie."""
    text, spans = "", []
    for i, part in enumerate(line.replace("]", "[").split("[")):
        if i % 2:
            spans.append((len(text), len(text) + len(part)))
        text += part
    return text, spans
