"""Code lists, word lists and patterns that define right results.

Results depend on these values literally, and on the order of the rules.
"""

# Survey codes that mean "no answer", as numbers and as text.
MISSING_CODES = (888, 999)

# Class codes of the forest tables.
FOREST_CODES = {"MDF": 0, "DDF": 1, "DEF": 2}

# Codes of the three motor-imagery labels.
IMAGERY_CODES = {110: 0, 120: 1, 150: 2}

# Entity tags: position in the list is the tag id.
ENTITY_TAGS = (
    "O",
    "B_BRN", "B_DES", "B_DTM", "B_LOC", "B_MEA", "B_NUM", "B_ORG", "B_PER", "B_TRM", "B_TTL",
    "I_BRN", "I_DES", "I_DTM", "I_LOC", "I_MEA", "I_NUM", "I_ORG", "I_PER", "I_TRM", "I_TTL",
    "E_BRN", "E_DES", "E_DTM", "E_LOC", "E_MEA", "E_NUM", "E_ORG", "E_PER", "E_TRM", "E_TTL",
)

# Word lists of the tag correction rules.
ANIMAL_WORDS = (
    "นกมูลไถ", "พังพอน", "ลิง", "หงส์", "นกแขกเต้า", "เต่า", "กวาง", "จระเข้", "นกหัวขวาน",
    "กบเขียว", "ปูทอง", "ปู", "นกต้อย", "นกดุเหว่า", "ปลา", "นกเค้า", "นก", "ช้าง", "กระต่าย",
    "นาก", "เหยี่ยว", "หงส์ทอง", "หมูป่า", "แรด",
)
HUNTER_WORD = "นายพราน"
TITLE_WORDS = ("ท้าว", "พญา", "ท่าน", "พระ")
RULER_WORDS = ("ท้าว", "เจ้า")
SELF_WORDS = ("_", "เรา", "ข้าพเจ้า")
ORDINAL_WORD = "ที่"

# Names: text that marks an element of the comma list as not a name.
VOLUME_MARK = "Vol.12"

# Names: elements that are dropped when they equal one of these.
STOP_ENTRIES = (
    " Dr.", " ", "", ",", "(", ")", "และคณะ", "et.al", "et al", ". .", "- -", "-- --",
    "Authors :", "B. Pharm.", "M. Pharm.", "TSME Thailand", "Editorial", "บทบรรณาธิการ",
)

# Names: ordered (pattern, replacement) rules on the whole string.
PHRASE_RULES = (
    (r"(TSME Thailand|Cover SNRUJST|subcommittee on the preparation of monofraphs of selected thai materia medica|subcommittee on the preparation of Monographs of Selected Thai Materia Medica| และคณะ|พระครูใบฎีกา)", ""),
    (r" and Other", ""),
    (r" Authors :", ""),
    (r"   ", " "),
    (r"  ", " "),
    (r"( 1 | i )", " "),
    (r" ๋j", " J"),
    (r"O’CONNELL", "O'Connell"),
    (r"LE-THANH", "Le-Thanh"),
    (r"DwiJoko", "Dwi Joko Suroso"),
    (r"RIAM-AMATAKUN", "Riam-Amatakun"),
    (r"SAE-JOO", "Sae-Joo"),
    (r"(^Ms\.|^Mr\.|^M\.L\.|^์|^ื|คณะนักศึกษาหลักสูตรป้องกันราชอาณาจักร รุ่นที่ 57|เกี่ยวกับวารสาร ABOUT THE JOURNAL|^พระมหา|ู^พระครู|Ven\. Dr\. |Assoc\.Prof\.Dr\.|Asst\.Prof\.Dr\.|ดร\. |Lect\. Dr\. |Assist\. Prof\. Dr\.|Assoc\. Prof\. Dr\. )", ""),
)

# Names: delimiters of the second split, and the marks blanked after it.
SECOND_DELIMITERS = r"(,|and Other|Authors :| \[| Dr\.)"
BRACKET_MARKS = r"( \[|\])"

# Names: degrees removed inside an entry.
DEGREES = r"(รศ\.ดร\. |อ\.ดร\.|ผศ\.ดร\.|M\.R\.|M\.D\.|CFA|Jr\.|Ph\.D)"

# Names: titles and ranks, first and second pass.
TITLES_FIRST = r"(Editorial Team|Author JPHD|พระครูสังฆรักษ์|บรรณาธิการ|พระเทพ|พระมหาอุดร |พระมหา|พระครู|\]| \[| \-|ผศ\.|อ\.|ม\.ร\.ว\.|ว่าที่ ร\.ต\. |ว่าที่ พ\.ต\. |ผศ\.ดร\.|ดร\.|นางสาว|^Dr\. |^Dr\.|^รศ\.|^รศ\.ดร\. |^อาจารย์ ดร\.|^อาจารย์ |^ว่าที่ร้อยตรี|^ว่าที่ รต |^ว่าที่ พต |\*$|^นาย|^นาง|\"|, |ผู้ช่วยศาสตราจารย์ |รองศาสตราจารย์ |^\(|^\) |สำนักส่งเสริมวิชาการและงานทะเบียน มรภวไลยอลงกรณ์ ในพระบรมราชูปถัมภ์|บทบรรณาธิการ \(Editorial\|Journal of Thai Traditional Alternative Medicine|พัฒนาตำราและวารสาร วิทยาลัยดุสิตธานี Dusit Thani College|คณะนักศึกษาหลักสูตรป้องกันราชอาณาจักร รุ่นที่ 57)"
TITLES_SECOND = r"(^สังฆรักษ์|เจ้าหน้าที่สาธารณสุขโรงพยาบาลส่งเสริมสุข| M\.hum| Sahufi L\.|ร\.ต\.| ประพันธ์วงศ์$|^อุดร | Phithakphongphan$|พระครูปลัดบำรุง |พระมหา|พระครู)"

# Names: the isolated degree "MA"; a word character is a letter, a digit or "_".
ISOLATED_MA = r"(?<![\p{L}\p{N}_])MA(?![\p{L}\p{N}_])"

# Names: single entries with a known split.
ENTRY_OVERRIDES = (("กัลยา บุญหล้า และศศิธร โกฎสืบ", ("กัลยา บุญหล้า", "ศศิธร โกฎสืบ")),)

# Names: words that keep their spelling in the case rule.
CASE_EXCEPTIONS = (
    "E.B.", "A.B.", "Phokhwang-Just", "B.M.", "F.K.", "Yow-Mow", "C.A", "U.N.", "Sitti-Amorn",
    "O’Connor", "Sae-Jong", "SU", "Chi-Wei", "Chunthorng-Orn", "Ya-Liang", "KongpanJittima",
    "Chai-adisaksopha", "Sang-ubon", "O-Tur", "M.N.", "Swangchan-Uthai", "Na-nakorn", "of",
    "Thong-Aram", "Sudasna-na-Ayudthya", "bin", "San-Um", "Lee-Shuan", "Settheetham-Ishida",
    "Okafor-Terver", "McLoughlin", "Ua-Kit", "MuangKaow", "Yun-Bae-Kim", "O'Connell", "Im-Aim",
    "NumChai", "T.C.", "Le-Thanh", "N.K.", "A.R.M.", "G.R.", "S.S.", "V.S.", "LOUG-UI1",
    "Eam-Urai", "A.A.", "K.O.", "E.O.", "S.A.", "Ratana-Olarn", "Jit-Aree", "Jean-Noël", "G.J",
    "EI-sayed", "El-Aziz", "Sae-Lee", "McDaniel", "O-Prasertsawat", "Sitthi-Amorn", "Jan-Frits",
    "Uan-On", "J.S.", "I-Ming", "McDonough", "Riam-Amatakun", "R.S.", "M.Q.", "N.J.", "Amir-Ali",
)

# Names: ordered literal replacements of the second rule pass.
LITERAL_RULES = (
    ("Pra ", ""),
    ("Phra ", ""),
    ("ผู้ทรงคุณวุฒิ", ""),
    ("แนะนำผู้เขียน", ""),
    ("กอง ผู้เชี่ยวชาญ", ""),
    ("บท วารสารวิชาการและวิจัยสังคมศาสตร์", ""),
    ("บท วารสารวิชาการและวิจัยสังคม", ""),
    ("กอง วารสารรัฏฐาภิรักษ์", ""),
    ("Mohd. ", ""),
    ("พระปลัด", ""),
    ("วารสารมหาวิทยาลัยราชภัฏสกลนคร", ""),
    ("กอง กอง", ""),
    ("เสาวลักษณ์ กูเจริญประสิทธิ์", "เสาวลักษณ์ กู้เจริญประสิทธิ์"),
    ("วรวรรณ ตุมมงคล", "วรวรรณ ตุ มมงคล"),
    ("คณะมนุษยศาสตร์ มหาวิทยาลัยรามคำแหง", ""),
    ("Somboon ๋jarukasemthawee", "Somboon Jarukasemthawee"),
    ("บท บท", ""),
    ("Dwi Joko Suroso Suroso", "Dwi Joko Suroso"),
    ("Ms.", ""),
    ("Mr.", ""),
    ("รศรินทร เกรย", "รศรินทร์ เกรย์"),
    ("สาลินี เทพสุวรรณ", "สาลินี เทพสุวรรณ"),
    ("Dusayu@kku.ac.th ", ""),
    ("อาจารย์", ""),
    ("กอง วารสาร", ""),
    ("Journal of Thai Traditional Alternative Medicine", ""),
    ("พระ", ""),
    ("นพ.", ""),
    ("คณะการสื่อสารมวลชน มหาวิทยาลัยเชียงใหม่", ""),
    ("Phramaha ", ""),
    ("Phrakru ", ""),
    ("Dhammathas Academic Journal", ""),
    ("วารสารวิทยาการจัดการ", ""),
    ("คำแนะนำสำหรับผู้เขียน วารสารวิทยาการจัดการ", ""),
    ("รายละเอียดบทความ วารสารวิทยาการจัดการ", ""),
    ("วารสารมนุษยศาสตร์และสังคมศาสตร์ มหาวิทยาลัยราชภัฏสุรินทร์", ""),
    (" .", ""),
    ("สำนักส่งเสริมวิชาการและงานทะเบียน มรภ.วไลยอลงกรณ์ ในพระบรมราชูปถัมภ์", ""),
)

# Patterns of the name rules: a word or blanks in brackets, a name with an alias in brackets, Thai followed by Latin.
WORD_OR_SPACE_IN_PARENS = r"\([\p{L}\p{N}_\s]+\)"
NAME_AND_ALIAS = r"([^\(]+)\(([^\)]+)\)"
THAI_THEN_LATIN = r"[\u0E00-\u0E7F]+ [a-zA-Z0-9]+"

# How the alternatives of the longer patterns begin, for a quick look before they are tried one by one.
STARTS = {
    PHRASE_RULES[0][0]: r"[TCพ]|su| แ",
    PHRASE_RULES[12][0]: r"[Mคเดู์ืพVAL]",
    SECOND_DELIMITERS: r"[,A]|and O| [\[D]",
    DEGREES: r"[รอผMCJP]",
    TITLES_FIRST: r"[EAพบ\]ผอมวดนDร*\",()สค]| [\[\-]",
    TITLES_SECOND: r"[สเรอพ]| [MSปP]",
    ISOLATED_MA: r"MA",
}
