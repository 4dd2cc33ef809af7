"""Messages written by hand, apart from the frames of the labelled sample; items are marked [[type:text]]."""

import re

from spindrel.llm import pii

MESSAGES = """
Dr. [[name:Anjali Gupta]] and Prof. [[name:John O'Neill]] both complained about the export.
[[name:Priya Sharma]] here, I cannot open my profile since Friday.
We spoke to Professor [[name:Iyer]] on Monday and nothing happened.
Parcels for the lab should go to [[address:14 Baker Street, London NW1 6XE]].
I live at [[address:221 Hauz Khas Enclave, New Delhi 110016]] and the map puts me in Mumbai.
Contact [[name:Rahul Verma]] at [[email:rahul.verma@physx.ac.in]] if the upload fails.
My SSN [[id_number:123-45-6789]] was shown on the page, please hide it.
Call [[phone:+44 20 7946 0958]] or [[phone:(415) 555-2671]] during office hours.
Passport [[id_number:K8123456]] is attached to the wrong account.
The [[email:help_desk@lib.example.org]] mailbox bounced twice yesterday.
Regards,
[[name:Fatima Khan]]
The Chemistry building lost power in March 2021.
Version 2.14.3 of the viewer crashes on page 12.
Search for "graph neural networks" gives 0 results.
Ticket 483920 has been open since 2023-04-11.
Our landline is [[phone:011-26591234]], fax does not work.
Write to me: [[email:chen.wei at example dot com]]
Aadhaar [[id_number:4821 7730 9912]] does not belong in a public profile!
My name is [[name:Carlos Fernandez]], I teach robotics at the Mechanical block.
Dear Ms. [[name:Haddad]], the figures for 2019 are wrong.
Send the certificate to [[address:Flat 7A, Lotus Apartments, Sector 12, Noida 201301]]. Thank you
The Ganga hostel kiosk shows the wrong time.
Please ask [[name:K. Pillai]] whether the list of 45 papers is complete.
ISBN 978-0-262-03384-8 is not found.
The DOI 10.1016/j.cell.2020.01.021 leads nowhere.
Sorry, wrong number, use [[phone:98765 43210]] instead.
cc [[name:Tanaka, Kenji]] and the library team
my pan card is [[id_number:ABCPS1234K]] but the form rejects it
Kind regards, [[name:Emma Larsen]]
Why does Thursday come before Wednesday in the calendar?
Theme colours are too bright on the dashboard.
"""


def test_messages_by_hand():
    texts, truth = [], []
    for line in MESSAGES.strip().split("\n"):
        text, items = "", set()
        for k, part in enumerate(re.split(r"\[\[(.*?)\]\]", line)):
            if k % 2:
                kind, value = part.split(":", 1)
                items.add((kind, len(text), len(text) + len(value)))
                part = value
            text += part
        texts.append(text)
        truth.append(items)
    found = [{(pii.TYPES[k], a, b) for k, a, b, _ in own} for own in pii.model().items(texts)]
    right = sum(len(a & b) for a, b in zip(found, truth))
    wrong = [(t, sorted(a ^ b)) for t, a, b in zip(texts, found, truth) if a != b]
    assert right / sum(map(len, truth)) >= 0.9 and right / max(1, sum(map(len, found))) >= 0.9, wrong
