"""Small made-up records of every source format, for queries and tests that need no bulk data."""

GEN1 = """HEADER LINE
PATN
WKU  039305848
SRC  5
APN  1234567
APD  19740101
TTL  Widget and
     maker
ISD  19760106
NCL  12
ASSG
NAM  Caf\xe9 Inc.
CTY  Paris
CNT  FRX
ASSG
NAM  Second Corp
STA  CA
CLAS
ICL  A61B 512
ICL  A61B
EDF  2
UREF
PNO  3000001
UREF
PNO  D0200002
ABST
PAL  One
PAR  Two
PATN
WKU  D02389762
SRC  D
APN  7654321
ISD  19760106
"""
GEN2 = """<?xml version="1.0"?>
<!DOCTYPE PATDOC SYSTEM "x.dtd" [
<!ENTITY a SYSTEM "b">
]>
<PATDOC><SDOBI><B100><B110><DNUM><PDAT>06167569</PDAT></DNUM></B110><B140><DATE><PDAT>20010102</PDAT></DATE></B140></B100>
<B200><B210><DNUM><PDAT>09123456</PDAT></DNUM></B210><B220><DATE><PDAT>19990101</PDAT></DATE></B220></B200>
<B500><B510><B511><PDAT>A41D 1300</PDAT></B511><B512><PDAT>A41D 2700</PDAT></B512><B516><PDAT>7</PDAT></B516></B510><B540><STEXT><PDAT>Coat &mdash; long</PDAT></STEXT></B540>
<B560><B561><PCIT><DOC><DNUM><PDAT>2761147</PDAT></DNUM></DOC></PCIT></B561></B560><B570><B577><PDAT>3</PDAT></B577></B570></B500></SDOBI>
<SDOAB><BTEXT><PARA><PTEXT><PDAT>First</PDAT></PTEXT></PARA><PARA><PTEXT><PDAT>Second</PDAT></PTEXT></PARA></BTEXT></SDOAB></PATDOC>
<?xml version="1.0"?>
<PATDOC><SDOBI><B100></SDOBI></PATDOC>
"""
GEN3 = """<?xml version="1.0"?>
<us-patent-grant><us-bibliographic-data-grant><publication-reference><document-id><doc-number>10000001</doc-number><date>20180619</date></document-id></publication-reference>
<application-reference><document-id><doc-number>14000001</doc-number><date>20150101</date></document-id></application-reference>
<classifications-ipcr><classification-ipcr><ipc-version-indicator><date>20060101</date></ipc-version-indicator><section>G</section><class>06</class><subclass>F</subclass><main-group>9</main-group><subgroup>44</subgroup></classification-ipcr></classifications-ipcr>
<invention-title>Fast <b>bold</b> thing</invention-title><number-of-claims>20</number-of-claims>
<us-references-cited><us-citation><patcit><document-id><country>US</country><doc-number>06167569</doc-number><kind>B1</kind></document-id></patcit></us-citation>
<us-citation><patcit><document-id><country>US</country><doc-number>2001</doc-number><kind>00</kind></document-id></patcit></us-citation>
<us-citation><patcit><document-id><country>EP</country><doc-number>1</doc-number><kind>A</kind></document-id></patcit></us-citation></us-references-cited>
<assignees><assignee><addressbook><orgname>Second Corporation</orgname><address><city>Rome</city><country>IT</country></address></addressbook></assignee></assignees>
</us-bibliographic-data-grant><abstract><p>Hello</p><p>world</p></abstract></us-patent-grant>
"""
PAB = """<patent-application-publication><subdoc-bibliographic-information><document-id><doc-number>20010000001</doc-number><document-date>20010315</document-date></document-id>
<domestic-filing-data><application-number><doc-number>09500001</doc-number></application-number><filing-date>20000201</filing-date></domestic-filing-data>
<technical-information><classification-ipc><classification-ipc-primary><ipc>B01D 3</ipc></classification-ipc-primary><classification-ipc-edition>007</classification-ipc-edition></classification-ipc><title-of-invention>Still</title-of-invention></technical-information>
<assignee><organization-name>Second Corp.</organization-name></assignee><inventors><first-named-inventor><residence><residence-non-us><city>Oslo</city><country-code>NO</country-code></residence-non-us></residence></first-named-inventor></inventors></subdoc-bibliographic-information></patent-application-publication>"""
IPAB = """<us-patent-application><us-bibliographic-data-application><publication-reference><document-id><doc-number>20190000001</doc-number><date>20190103</date></document-id></publication-reference>
<application-reference><document-id><doc-number>15000001</doc-number><date>20170101</date></document-id></application-reference><invention-title>Rig</invention-title>
<assignees><assignee><addressbook><orgname>Zyx GmbH</orgname></addressbook></assignee></assignees><us-parties><us-applicants><us-applicant><addressbook><address><city>Ulm</city><country>DE</country></address></addressbook></us-applicant></us-applicants></us-parties></us-bibliographic-data-application></us-patent-application>"""


def transfer(frame, giver, taker, text, documents):
    docs = "".join(f"<document-id><doc-number>{n}</doc-number><kind>{k}</kind></document-id>" for n, k in documents)
    return f"""<patent-assignment><assignment-record><reel-no>1234</reel-no><frame-no>{frame}</frame-no><conveyance-text>{text}</conveyance-text><recorded-date><date>20100202</date></recorded-date></assignment-record>
<patent-assignors><patent-assignor><name>{giver}</name><execution-date><date>20100101</date></execution-date></patent-assignor></patent-assignors><patent-assignees><patent-assignee><name>{taker}</name></patent-assignee></patent-assignees>
<patent-properties><patent-property>{docs}</patent-property></patent-properties></patent-assignment>"""


ASSIGN = "<us-patent-assignments>" + transfer(7, "Second Corp", "ZYX GMBH", "ASSIGNMENT OF ASSIGNORS INTEREST", [("10000001", "B2"), ("10000009", "A1"), ("6167569", "B1")]) + transfer(8, "Smith, John", "ZYX GMBH", "ASSIGNMENT", [("1", "B1")]) + transfer(9, "Second Corp", "ZYX GMBH", "SECURITY AGREEMENT", [("1", "B1")]) + "</us-patent-assignments>"
MARKS = """<x><case-file><serial-number>70000001</serial-number><case-file-header><filing-date>18840407</filing-date></case-file-header>
<case-file-statements><case-file-statement><type-code>GS0011</type-code><text>TEA</text></case-file-statement><case-file-statement><type-code>PM0001</type-code><text>No</text></case-file-statement></case-file-statements>
<classifications><classification><us-code>046</us-code><international-code>030</international-code><us-code>047</us-code></classification></classifications>
<case-file-owners><case-file-owner><party-name>Tea Co</party-name></case-file-owner><case-file-owner><party-name>Tea Co</party-name></case-file-owner></case-file-owners></case-file></x>"""
MAINT = ["0000006167569 09123456 Y 20000101 20010101 20040101 M2551", "0000006167569 09123456 N 20000101 20010101 20080101 M172 ", "0000010000001 14000001 Y 20150101 20180619 20190101 EXP. "]
ACCOUNTS = """row,gvkey,fyear,conm,AT,CAPX,CH,COGS,CSHO,DP,EBITDA,EMP,INTAN,LT,REVT,SALE,XRD,XSGA,prcc_f,NAICS,SIC
1,100,2018,ZYX GMBH,5,1,1,1,2,1,1,1,1,1,1,1,,1,3,334,3570
2,,2018,NONE,5,1,1,1,2,1,1,1,1,1,1,1,1,1,3,,
"""


def fixed(line):
    p = line.split()
    return f"{p[0]:13} {p[1]:8} {p[2]} {p[3]:8} {p[4]:8} {p[5]:8} {p[6]:5}"

#: A second grant file: classes by edition, citations of the older form, two records in one file.
GEN3_OLD = """<?xml version="1.0"?>
<us-patent-grant><us-bibliographic-data-grant><publication-reference><document-id><doc-number>07000001</doc-number><date>20060214</date></document-id></publication-reference>
<application-reference><document-id><doc-number>10000777</doc-number><date>20030101</date></document-id></application-reference>
<classification-ipc><edition>07</edition><main-classification>F16H 100</main-classification><further-classification>F16H 5704</further-classification></classification-ipc>
<invention-title>Gear &amp; shaft &eacute;</invention-title><number-of-claims>x</number-of-claims>
<references-cited><citation><patcit><document-id><country>US</country><doc-number>D0400001</doc-number><kind>S</kind></document-id></patcit></citation>
<citation><patcit><document-id><country>DE</country><doc-number>777</doc-number><kind>A</kind></document-id></patcit></citation></references-cited>
<assignees><assignee><addressbook><orgname>Acme Gears Ltd.</orgname><address><city>Boise</city><state>ID</state><country>US</country></address></addressbook></assignee>
<assignee><addressbook><orgname>Never Seen</orgname></addressbook></assignee></assignees>
</us-bibliographic-data-grant></us-patent-grant>
<?xml version="1.0"?>
<us-patent-grant><us-bibliographic-data-grant><publication-reference><document-id><doc-number>RE040001</doc-number><date>20060214</date></document-id></publication-reference></us-bibliographic-data-grant></us-patent-grant>
"""
PAB_US = """<patent-application-publication><subdoc-bibliographic-information><document-id><doc-number>20010000002</doc-number><document-date>20010322</document-date></document-id>
<domestic-filing-data><application-number><doc-number>09500002</doc-number></application-number><filing-date>20000301</filing-date></domestic-filing-data>
<technical-information><classification-ipc><classification-ipc-primary><ipc>G01N 33</ipc></classification-ipc-primary><classification-ipc-secondary><ipc>C12Q 168</ipc></classification-ipc-secondary><classification-ipc-edition>07</classification-ipc-edition></classification-ipc><title-of-invention>Probe</title-of-invention></technical-information>
<inventors><first-named-inventor><residence><residence-us><city>Reno</city><state>NV</state><country-code>US</country-code></residence-us></residence></first-named-inventor></inventors></subdoc-bibliographic-information>
<subdoc-abstract><paragraph>Some</paragraph><paragraph>Text</paragraph></subdoc-abstract></patent-application-publication>"""
IPAB_OLD = """<us-patent-application><us-bibliographic-data-application><publication-reference><document-id><doc-number>20060000002</doc-number><date>20060105</date></document-id></publication-reference>
<application-reference><document-id><doc-number>11000002</doc-number><date>20050101</date></document-id></application-reference><invention-title>Pump</invention-title>
<classification-ipc><edition>007</edition><main-classification>F04B 100</main-classification></classification-ipc>
<parties><applicants><applicant><addressbook><address><city>Lyon</city><country>FR</country></address></addressbook></applicant></applicants></parties></us-bibliographic-data-application><abstract><p>One</p><p>two</p></abstract></us-patent-application>"""
MARKS_TWO = """<x><case-file><serial-number>70000002</serial-number><case-file-header><registration-date>18840506</registration-date></case-file-header>
<case-file-statements><case-file-statement><type-code>GS0301</type-code><text>Oil</text></case-file-statement><case-file-statement><type-code>GS0302</type-code><text>Soap</text></case-file-statement></case-file-statements>
<case-file-owners><case-file-owner><party-name>B Co</party-name></case-file-owner><case-file-owner><party-name>A Co</party-name></case-file-owner><case-file-owner><party-name>B Co</party-name></case-file-owner></case-file-owners></case-file></x>"""
MAINT_OLD = ["0000009999999 09123456 Y 20000101 20010101 20040101 M170 ", "RE0350001 08000001 N 20000101 20010101 20040101 M183 "]
ACCOUNTS_TWO = """row,gvkey,fyear,conm,AT,CAPX,CH,COGS,CSHO,DP,EBITDA,EMP,INTAN,LT,REVT,SALE,XRD,XSGA,prcc_f,NAICS,SIC
1,100,2018,ZYX GMBH,5,1,1,1,2,1,1,1,1,1,1,1,,1,3,334,3570
2,,2018,NONE,5,1,1,1,2,1,1,1,1,1,1,1,1,1,3,,
3,101,2019.0,Acme Inc,7.5,,0,1,4,1,1,1,1,1,1,1,2,1,0.25,3344135,
4,102,2019,,5,1,1,1,2,1,1,1,1,1,1,1,1,1,3,,
"""


#: Every file of a data folder, by its place under ``raw``.
FILES = {
    "grant/a.dat": GEN1, "grant/pgb1.xml": GEN2, "grant/ipgb1.xml": GEN3, "apply/pab1.xml": PAB, "apply/ipab1.xml": IPAB, "assign/ad.xml": ASSIGN, "tmapply/apc1.xml": MARKS,
    "maint/MaintFeeEvents_20200101.txt": "\n".join(map(fixed, MAINT)) + "\n", "compustat/compustat.csv": ACCOUNTS,
}
#: Files that come later, or that no reader takes.
MORE = {
    "grant/ipgb2.xml": GEN3_OLD, "grant/notes.txt": "PATN\nWKU  01111111\n", "apply/pab2.xml": PAB_US, "apply/ipab2.xml": IPAB_OLD, "tmapply/apc2.xml": MARKS_TWO,
    "maint/MaintFeeEvents_20190101.txt": "\n".join(map(fixed, MAINT_OLD)) + "\n", "maint/readme.txt": "0000001111111 09123456 Y 20000101 20010101 20040101 M170 \n", "compustat/two.csv": ACCOUNTS_TWO,
}
