"""Hand-written texts with the personal data in them; none follows a training template."""

CASES = [
    ("Hi, it's Tom from the garage. Ring me back on (312) 867-5309 before five.", ["(312) 867-5309"]),
    ("You can text 646.220.1849 if the gate is locked.", ["646.220.1849"]),
    ("Office fax: 030 8817 2290, ask for the second floor.", ["030 8817 2290"]),
    ("Her social security number is 219-09-9999 according to the form.", ["219-09-9999"]),
    ("The applicant wrote 078-05-1120 in the box.", ["078-05-1120"]),
    ("Send the photos to lena.k (at) posteo (dot) de, thanks!", ["lena.k (at) posteo (dot) de"]),
    ("webmaster[at]riverclub.org answers within a week", ["webmaster[at]riverclub.org"]),
    ("Drop a line to sam99 at fastnet dot co and he will help.", ["sam99 at fastnet dot co"]),
    ("Please wire the rent to DE44 5001 0517 5407 3249 31 by Friday.", ["DE44 5001 0517 5407 3249 31"]),
    ("IBAN FR1420041010050500013M02606 belongs to the club.", ["FR1420041010050500013M02606"]),
    ("The printer at 2001:0db8:85a3:0000:0000:8a2e:0370:7334 is offline.", ["2001:0db8:85a3:0000:0000:8a2e:0370:7334"]),
    ("Block the laptop 3c:52:82:1f:aa:09 on the router.", ["3c:52:82:1f:aa:09"]),
    ("Patient file: DOB 14/02/1967, allergic to penicillin.", ["14/02/1967"]),
    ("Sie wurde am 3.11.1988 geboren; Geboren am 3.11.1988 steht im Pass.", ["3.11.1988"]),
    ("Yesterday Mrs. Whitcombe called the school twice.", ["Mrs. Whitcombe"]),
    ("Ask Dr Amara Okafor whether the results are in.", ["Dr Amara Okafor"]),
    ("Hello, my name is Pedro Salvatierra and I would like a refund.", ["Pedro Salvatierra"]),
    ("They moved to 48 Orchard Lane last spring.", ["48 Orchard Lane"]),
    ("Deliver it to 1600 Pennsylvania Avenue, side entrance.", ["1600 Pennsylvania Avenue"]),
    ("Er wohnt in der Schillerstraße 17 im dritten Stock.", ["Schillerstraße 17"]),
    ("Elle habite 12 rue de Rivoli depuis dix ans.", ["12 rue de Rivoli"]),
    ("La tienda está en Calle Serrano 45, junto al banco.", ["Calle Serrano 45"]),
    ("Follow @green_thumb42 for more pictures of the garden.", ["@green_thumb42"]),
    ("The cabin's GPS position is 47.60621, -122.33207 exactly.", ["47.60621, -122.33207"]),
    ("Le téléphone de la mairie : 01 42 76 40 40.", ["01 42 76 40 40"]),
    ("Mi móvil es 0612 3344 5566, llámame.", ["0612 3344 5566"]),
    ("Passport no. 533380006 expires in May.", ["533380006"]),
    ("Bitte überweisen Sie auf Konto 4711 0815 442.", ["4711 0815 442"]),
    ("Frau Lindqvist und Herr Papadakis kamen zu spät.", ["Frau Lindqvist", "Herr Papadakis"]),
    ("Contact: 020 7946 0958, evenings only.", ["020 7946 0958"]),
    # Nothing personal in these.
    ("The meeting was moved from 2021-03-04 to 2021-03-11.", []),
    ("Order 7719922011 shipped on Monday.", []),
    ("See ISBN 978-0-306-40615-7 for the full derivation.", []),
    ("The war lasted from 1914 - 1918 and changed everything.", []),
    ("Version 10.4.22.1907-33 fixes the crash.", []),
    ("Its population grew to 12 450 000 within a decade.", []),
    ("Pi is 3.14159265358979 to fourteen places.", []),
    ("Add 250 ml of water, 30 g of salt and 12 eggs.", []),
    ("The total came to $1 249 300 after tax.", []),
    ("Use @override above the method and @property below it.", []),
    ("Look at example.com for the manual.", []),
    ("They met at noon in the old mill.", []),
    ("It rained 12 days in June 2019 and 9 in July 2019.", []),
    ("Serial 88230017745 is printed on the back.", []),
    ("In Figure 12 the ratio is 0.8812, 0.9120 and falling.", []),
    ("Run it with port 8080 and 65536 workers.", []),
    ("The score was 101-99 after 48 minutes.", []),
    ("Chapter 12, pages 220-248, covers the reform.", []),
    ("Add 00:11:22:33 to the timer.", []),
    ("The table lists 1 2 3 4 5 6 7 8 9 10 in order.", []),
    ("Released on 4 April 1995 to mixed reviews.", []),
    ("I am Happy to help, and I am Sorry for the delay.", []),
    ("The sum 123456789012345678 overflows a double.", []),
    ("Section 4.2.1 follows 3.9.12 in the new edition.", []),
    ("Model XK-2200/8 replaces XK-2100/7.", []),
]
