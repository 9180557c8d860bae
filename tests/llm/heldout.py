"""Held-out sentences with personal information, written by hand apart from the generator of the training data.

``cases()`` sets each sentence with several hand-written items: (text, start, end, kind), and the sentences
without any. None of the sentences is a template of the generator; family names are real or invented.
"""

from __future__ import annotations

NAMES = """Xiaoming Wang|Margaret Thornquist|Guillermo Echevarría|Bartholomew Quennell|Ayodele Bankole|Ingeborg Raszewski|Tilda Marchbanks|Rupert Ashgrove|Mehwish Qureshi|Solveig Aamodt|Desmond Tallow|Philippa Venn|Giorgio Malaspina|Katarzyna Wrona|Emre Karadeniz|Noriko Fujimura|Dylan O'Rourke|Marguerite de Valois|Johannes van Eeden|Beatriz Figueira
J. R. Hartley|T. Okonjo|P.~Dvořák|A. B. Featherstone|M. Castellanos|K. Brightwater|L.~M. Sorensen|D. Pappas|H. Grunewald|S. Yilmazer
Hartley, James|Marchetti, Paola|Oyelaran, Bisi|Drummond, F.|Szabo, Istvan|Quennell, B. T.|Fujimura, Noriko
ELLEN WHITCOMBE|RAJESH PATNAIK|Gareth B. Llewellyn|Odette M. Charpentier|Frank Mc\\"unther|Bj\\"orn Dahlqvist|Ren\\'e Descharnes|Anne-Sophie Vautrin|Karl-Heinz Obermeier|Maria Teixeira-Lobo""".replace("\n", "|").split("|")

NAME_SENTENCES = """The translation was checked by {} before printing.
Our thanks go to {}, whose notes were of great use.
Last week {} presented the results in front of the board.
Both drafts had been signed by {} and returned.
A second opinion came from {} of the municipal clinic.
Dr. {} will see you at nine.
Please forward this to {} as soon as you can.
The prize was shared between {} and a small firm.
I spoke with {} about the leak in the roof.
According to Prof. {} the samples were too old.
The defendant, {}, did not appear in court.
During the interview {} said that the door was open.
% note from {}: the second figure is wrong
The poem is attributed to {}.
In his will {} left the house to the town.
\\thanks{{Supported by {} in the first year.}}
Photographs: {}
Minutes taken by {}.
My neighbour {} heard the noise as well.
This was later confirmed by {} in a letter.
Mrs {} has rented the flat since May.
The cello was played by {}.
Wie {} berichtet, war die Probe verunreinigt.
D'après {}, la mesure était fausse.
Según {}, la muestra era antigua.
Attendance: {} (chair), two guests.
The code was reviewed by {} last night.
We are indebted to {} for the photographs.""".split("\n")

EMAILS = """john.smith@gmail.com|info@company.de|wang.li@tsinghua.edu.cn|a.b.carter@physics.ox.ac.uk|kontakt@stadtwerke-muenchen.de|maria_lopez77@hotmail.es|editor@journal-of-things.org|tkm@utu.fi|support@tools.io|r.patel@iitb.ac.in|helpdesk@city.gov|j-doe@mail.example.com|yuki.mori@riken.jp|contact@librairie.fr|bob+work@startup.ai|s.novak@fel.cvut.cz|office@parish.org.uk|lena@posteo.net
jane dot doe at example dot com|kruger at mpi dot de|s.lee [at] snu.ac.kr|olsen (at) uio (dot) no|hr [at] firm [dot] com|q.brown(at)leeds.ac.uk|mara at cs dot ubc dot ca""".replace("\n", "|").split("|")

EMAIL_SENTENCES = """Please direct complaints to {} within ten days.
You may reach the editor under {} at any time.
For a copy, drop a line to {} and wait.
The list is kept by {} since January.
Reports of errors are welcome: {}
Her new address, {}, works from Monday on.
Anfragen bitte an {} richten.
Pour toute question, contactez {} directement.
Subscribe by sending mail to {} with an empty body.
\\thanks{{Corresponding author: {}}}
Tickets can be ordered from {} until noon.
The form goes back to {} after signing.
If the link is broken, tell {} about it.
(write to {} for the slides)
Para dudas escriba a {} cuanto antes.""".split("\n")

PHONES = """(415) 867-5309|212-736-5000|+1 650 253 0000|+44 20 7946 0018|020 7946 0991|0131 496 0123|+49 89 636 48018|030/901820|+33 1 42 68 53 00|01 42 68 53 00|+34 91 123 45 67|+39 06 6982 1234|+41 44 668 18 00|+46 8 123 456 78|+47 22 12 34 56|+358 9 1234567|+31 20 794 0000|+48 22 695 29 00|+420 224 372 111|+7 (495) 123-45-67|+91 98765 43210|+86 10 6275 1234|+81 3 3580 3311|+82 2 880 5114|+55 11 91234-5678|+61 2 9374 4000|1-800-555-0199|617.253.1000|(202) 456-1111 ext. 12|+14155550134""".split("|")

PHONE_SENTENCES = """After hours, ring {} and ask for the porter.
The clinic's number is {} on every day but Sunday.
Tel {}
He left a message at {} last night.
Bookings: {} (mornings only)
To cancel, phone {} before Friday.
Sie erreichen uns unter {} von acht bis zwölf.
Appelez le {} en cas d'urgence.
Fax your signed copy to {} please.
The plumber can be called on {} any time.
Reception {} or come by.
\\thanks{{Tel.: {}}}
For spare parts dial {} and press two.
Llame al teléfono {} por la tarde.
Her mobile, {}, was switched off.
Emergency contact {}""".split("\n")

IDS = """SSN|123-45-6789
SSN:|078-05-1120
passport no.|C01X00T47
social security number|219 09 9999
passport number|533380006
Passport No.|L898902C
national ID number|44051401359
tax ID|86 095 742 719
tax identification number|36574261809
DNI|12345678Z
NIE|X1234567L
identity card no.|T220001293
codice fiscale|RSSMRA85T10A562S
CPF|529.982.247-25
PAN|ABCPE1234F
Aadhaar|2345 6789 0123
National Insurance number|AB 12 34 56 C
NI number|QQ123456C
medical record number|MRN-4471209
patient ID|P-204518
patient record|00482913
personal number|811228-9874
CPR|070761-4285
henkilötunnus|131052-308T
BSN|111222333
PESEL|02070803628
NHS number|943 476 5919
driving licence no.|MORGA657054SM9IJ
Sozialversicherungsnummer|12 150780 J 009
numéro de sécurité sociale|2 55 08 14 168 025 38""".split("\n")

ID_SENTENCES = """The applicant gave {} {} on the second page.
{} {} was crossed out by the clerk.
In the margin we found {} {} in pencil.
Her {} {} had expired in June.
Enter {} {} in the field below.
The file is kept under {} {} until closed.
Volunteer seven ({} {}) withdrew.
Bitte {} {} angeben.
A copy of the card with {} {} was attached.
He was registered with {} {} in spring.
% remove before printing: {} {}
The witness was identified by {} {} only.""".split("\n")

ADDRESSES = """221B Baker Street, London|1600 Pennsylvania Avenue, Washington 20500|10 Downing Street, London SW1A 2AA|350 Fifth Avenue, New York, NY 10118|4 Privet Drive, Little Whinging|77 Massachusetts Avenue, Cambridge, MA 02139|12 Rowan Close, Fernhill 30412|58 Tanner Road, Apt. 9, Millbrook|9 Harbour Lane, Port Ellis 44120|P.O. Box 1423, Springfield 62701|P.O. Box 77, 10134 Norrvik|Unter den Linden 77, 10117 Berlin|Hauptstraße 5, 69117 Heidelberg|Goethestr. 12, D-60313 Frankfurt|Am Alten Markt 3, 14467 Potsdam|Bahnhofstrasse 45, 8001 Zürich|Lindenweg 8, 30159 Hannover|12 rue de la Paix, 75002 Paris|5, avenue Anatole, 75007 Paris|31 boulevard des Capucines, 69001 Lyon|8, place du Marché, 35000 Rennes|Via Garibaldi 16, 16124 Genova|Calle Mayor 21, 28013 Madrid|Rua Augusta 129, 1100-048 Lisboa|742 Evergreen Terrace, Springfield|15 Kestrel Way, Dunmore 90210|Flat 3, 18 Mill Lane, Oakford|200 Old Quarry Road, Westhaven 11542""".split("|")

ADDRESS_SENTENCES = """The parcel was left at {} by mistake.
Since March the family lives at {} again.
Invoices should be posted to {} only.
The workshop takes place at {} next week.
He grew up at {} with two sisters.
Head office: {}
Besuchen Sie uns: {}
Le colis est parti vers {} hier.
\\address{{{}}}
The burglary happened at {} at night.
Return the keys to {} by Friday.
Deliveries go to {} through the yard.
El paquete llegó a {} ayer.
We have moved to {} for the summer.""".split("\n")

PLAIN = """The Hartmann equation was solved in closed form by a student.
Unlike Fenwick, we keep the second term.
The Ulmer--Kessler bound is sharp.
See Section 4 of the Annual Report for details.
The Department of Applied Mathematics closed in August.
Trains from New York reach North Haven at noon.
The grant 2019-04731 paid for the mirrors.
ISBN 978-3-16-148410-0 is out of print.
See doi:10.1000/182 and arXiv:2101.00027 for proofs.
ORCID 0000-0002-1825-0097 was linked.
We ran job 48213377 on port 8080.
The server 192.168.10.14 answered at 3.5 ms.
It sold 1,204,553 copies between 1998 and 2004.
On 2021-03-14 09:26:53 the sensor failed.
The Monte Carlo estimate took 20000000 steps.
Lake Superior is deeper than Lake Ontario.
In the United Kingdom the Royal Society agreed.
Journal of Fluid Mechanics 512, 2004, 93--117.
The Poisson Process and the Markov Chain are linked.
Version 10.4.1 of the tool was tagged as release@main.
Smith et al. report the same in Table 3.
The French Revolution began in Paris.
Prices rose from 120.50 to 1338.25 in Q3.
Black holes and White dwarfs were counted.
The Great Northern Railway ran until 1922.
Order AX-449120 was shipped on Tuesday.
Pages 1021--1044 of the Proceedings are missing.
At the University of Salamanca the archive is open.
Die Kopplung der Welle hängt von der Grenze ab.
Les résultats de la Table 2 sont faux.
The Green function of the Dirichlet problem is known.
A talk at the National Library of Norway followed.
We used Support Vector Machines and Random Forests.
The Kepler Telescope saw it twice.
From 51,283,297 samples we kept 40,118.
Figure 7 shows the Northern Line at rush hour.
He met her at the dot of noon.
Chapter Nine is called The Long Road.
Project Gutenberg and the Internet Archive hold copies.
The ISSN 0028-0836 belongs to a weekly.""".split("\n")


def _with(sentences: list[str], items: list[tuple[str, ...]], kind: str, each: int) -> list[tuple[str, int, int, str]]:
    out = []
    for i, sentence in enumerate(sentences):
        for j in range(each):
            item = items[(i * each + j) % len(items)]
            text = "It was a slow year for the archive. " + sentence.format(*item) + " The rest of the page is empty."
            at = text.rindex(item[-1])
            out.append((text, at, at + len(item[-1]), kind))
    return out


def cases() -> list[tuple[str, int, int, str]]:
    return [
        *_with(NAME_SENTENCES, [(n,) for n in NAMES], "name", 6), *_with(EMAIL_SENTENCES, [(e,) for e in EMAILS], "email", 8), *_with(PHONE_SENTENCES, [(p,) for p in PHONES], "phone", 8),
        *_with(ID_SENTENCES, [tuple(i.split("|")) for i in IDS], "id_number", 10), *_with(ADDRESS_SENTENCES, [(a,) for a in ADDRESSES], "address", 8),
    ]
