"""The labelled table of the PII model: sentences with the personal data marked as [kind value]."""

ROWS = [
    "call me at [phone 555-123-4567] after lunch",
    "phone: [phone (980) 555-6268] or visit the desk",
    "Tel. [phone 030 1234 5678] (office)",
    "my number is [phone 212 555 0187] thanks",
    "fax [phone (415)555-0132] is out of order",
    "reach us on [phone 0049 30 901820] every day",
    "mobile [phone 07700 900123], ask for Ana",
    "telefon [phone 0171-2345678] abends",
    "numéro de téléphone [phone 01 23 45 67 89] le matin",
    "teléfono [phone 912 345 678] oficina",
    "contact [phone 555.867.5309] now",
    "call [phone 1-800-555-0199] toll free",
    "text [phone 650-555-0110] for details",
    "whatsapp [phone 0044 7700 900456] please",
    "her cell is [phone 303-555-0145].",
    "Tel: [phone 089/1234567] Zentrale",
    "call ext 12 at [phone 555-0123-4567] soon",
    "write to [email jane.doe@example.com] today",
    "e-mail [email info@mail.example.org] for help",
    "mail [email j_smith+news@example.co.uk] bitte",
    "mail me: [email max(at)example.de] danke",
    "contact [email office[at]example.org] please",
    "email [email anna.k(at)mail.example.com] if lost",
    "schreib an [email kurt@example] morgen",
    "courriel [email léa@exemple.fr] merci",
    "send it to [email bob(at)example.net], not here",
    "server [ip 192.168.10.4] is down",
    "from [ip 10.0.0.7] at night",
    "host [ip 172[.]16[.]4[.]9] was seen",
    "ip [ip 203[.]0[.]113[.]77] blocked again",
    "address [ip 198(.)51(.)100(.)23] in the log",
    "login from [ip 8.8.4.4] failed",
    "card [card 4111.1111.1111.1111] expired",
    "visa [card 4111_1111_1111_1111] paid",
    "paid with [card 5500/0000/0000/0004] yesterday",
    "credit card [card 4012888888881881] on file",
    "number [card 4222-2222-2222-2] charged",
    "mastercard [card 5105.1051.0510.5100] lost",
    "amex [card 3782.822463.10005] used",
    "karte [card 4111.1111.1111.1111] gesperrt",
    "in 1998 we sold 1200 units for 35 dollars",
    "version 3.2.1 was released on 2024-01-05",
    "version 10.15.7.1 build 4512 is stable",
    "section 4.1.2.3 of the manual",
    "see page 12, table 3 and figure 4.5",
    "the meeting starts at 12:30 and ends at 14:00",
    "order 20231105001234 shipped in 2 boxes",
    "id 84736251 was closed, id 84736252 is open",
    "token = 9f86d081884c7d659a2feaa0c55ad015a3bf4f1b",
    "commit 3f2a9bc touched 14 files and 220 lines",
    "the score was 21-17 after 90 minutes",
    "from 1914-1918 and 1939-1945 in Europe",
    "between 10 and 20 of the 300 guests",
    "ISBN 978-3-16-148410-0 costs 19.99 euro",
    "room 204, floor 2, building 7",
    "Licensed under the Apache License, Version 2.0.",
    "population 83,240,525 in 2020",
    "a ratio of 3/4 or 0.75 is fine",
    "https://example.com/en/7817?page=2 was read 31 times",
    "#1234 and #5678 are fixed in v2.3.4",
    "sensor 17 read 1013.25 at 07:45",
    "lot 5521-88 and part 77-120-3 are in stock",
    "code 0000123456789 is printed below",
    "the 2010s, the 1990s and the 80s",
    "follow @anna and @team_42 for news",
    "meet me @ noon, 5 pm at most",
    "add 250 g flour, 2 eggs and 100 ml milk",
    "invoice 2024/0117 total 1.250,00 EUR",
    "case 12-345-67 was heard in 2001",
    "serial 12345-67890-12345-67890 on the box",
    "sum 1111 2222 3333 4444 of the columns",
    "hash 5d41402abc4b2a76b9719d911017c592 matches",
    "dates 01.02.2023 and 28.02.2023 work",
    "x = 12.5, y = -3.75, z = 100",
    "chapter 1.2.3.4.5 explains it",
]
