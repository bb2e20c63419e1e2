"""The rules on sentences and texts once more, written out for DuckDB apart from the lists of ``functions.lexicon``, which they check."""

from __future__ import annotations

_COLI = r"e\s+coli|e\.\s+coli|e\.coli|e-coli|ecoli"
_MICROBE = rf"bakteri|kuman|parasit|{_COLI}|escherichia|salmonella|staphylo\w*|bacillus|coliform|histamin\w*|norovirus|virus"
_AGENT = rf"(?:{_MICROBE}|toksin|nitrit|nitrat|formalin|boraks|pestisida|sianida|logam\s+berat)"
_TEST = r"hasil\s+(?:uji|pengujian|pemeriksaan|analisis|laboratorium|lab)\b"
_RESULT = rf"(?:{_TEST}|labkesda\b|bpom\b)"
_FIND = "|".join([
    rf"{_RESULT}[^.\n]{{0,100}}?(?:positif|mengandung|terdeteksi|terbukti|melebihi|tercemar)",
    rf"{_RESULT}[^.\n]{{0,100}}?(?:menunjukkan|menyatakan)\s+(?:adanya\s+)?(?:kontaminasi|{_AGENT})",
    rf"{_RESULT}[^.\n]{{0,100}}?ditemukan\s+(?:\w+\s+){{0,3}}?(?:{_AGENT}|zat|kandungan|cemaran)",
    rf"positif\s+(?:mengandung\s+)?{_AGENT}",
    rf"(?:ditemukan|terdeteksi|mengandung)\s+(?:adanya\s+)?{_AGENT}",
    rf"(?:disebabkan|dipicu|akibat|penyebab(?:nya)?(?:\s+(?:adalah|ialah))?)\s+(?:oleh\s+)?(?:kadar\s+)?{_AGENT}\s+",
    rf"(?:{_RESULT}|hasil\s+penelitian)[^.\n]{{0,80}}?{_AGENT}",
    rf"kandungan\s+{_AGENT}[^.\n]{{0,40}}?(?:melebihi|ditemukan|tinggi)",
    rf"{_AGENT}\s+(?:\w+\s+)?ditemukan\s+(?:pada|di|dalam)\s+(?:sampel|makanan|menu|lauk|air|udang|ayam|telur|susu)",
])
_UNSETTLED = r"\b(?:belum|tidak|bukan|apakah|masih|menunggu|diharapkan|akan|kemungkinan|diduga|dugaan|jika|bila|untuk\s+mengetahui|untuk\s+memastikan|guna|negatif|biasanya|umumnya|lazim|bisa|dapat|mungkin)\b"


def says(c: str, p: str) -> str:
    return f"regexp_matches({c}, '(?i){p}')"


_UPTO = f"regexp_extract(x, '(?i)^((?s:.*?)(?:{_FIND}))', 1)"
_OPENS = f"regexp_matches(regexp_extract(x, '(?i){_FIND}'), '(?i)^(?:disebabkan|dipicu|akibat|penyebab)')"
_MODAL = says(f"substr(x, length({_UPTO}) + 1, 45)", r"\b(?:dapat|bisa|berpotensi|berisiko|mampu)\b")
FINDS = f"({says('x', _FIND)} AND NOT {says(_UPTO, _UNSETTLED)} AND NOT ({_OPENS} AND {_MODAL}))"
_CLEAN = rf"{_TEST}[^.\n]{{0,100}}\b(?:negatif|aman|layak\s+konsumsi|memenuhi\s+syarat|memenuhi\s+standar|tidak\s+ditemukan|tidak\s+terdeteksi|tidak\s+mengandung)\b"
_LAB = rf"laborat|labkesda|\bbb?pom\b|sampel|\buji\b|pengujian|bakteri|{_COLI}|swab|mikrobiolog"
CLEANS = f"({says('x', _CLEAN)} AND {says('x', _LAB)} AND NOT {says('x', 'psikolog|' + chr(92) + 'b(?:belum|menunggu|apakah|akan|jika|bila)' + chr(92) + 'b')})"
_AWAIT = "|".join([
    r"menunggu\s+hasil",
    r"hasil\b[^.\n]{0,60}\b(?:belum|masih)\b[^.\n]{0,30}(?:keluar|diketahui|ada|muncul|diterima|terbit)",
    r"belum\s+(?:diketahui|dapat\s+dipastikan|bisa\s+dipastikan|ada\s+kepastian)",
    r"penyebab\s+pasti[^.\n]{0,60}(?:belum|masih|menunggu)",
    r"(?:belum|masih)\s+(?:dalam\s+)?(?:proses\s+)?(?:pengujian|pemeriksaan|penyelidikan|diselidiki|diperiksa|diuji|diteliti)",
])
AWAITS = says("x", _AWAIT)
_SAMPLED = r"sampel\s+[^.\n]{0,60}(?:dikirim|diambil|diperiksa|diuji|dibawa|diserahkan)|(?:mengambil|mengirim|mengirimkan|membawa)\s+(?:\w+\s+){0,2}sampel|pengambilan\s+sampel"
STATE = f"""CASE WHEN len(list_filter(s, lambda x: {FINDS})) > 0 THEN 'contamination' WHEN len(list_filter(s, lambda x: {CLEANS})) > 0 THEN 'clean'
    WHEN {says("text", _AWAIT)} THEN 'awaiting' WHEN {says("text", _SAMPLED)} THEN 'samples' ELSE 'none' END"""
_STRONG = rf"hasil\s+(?:lab|uji|pemeriksaan|laboratorium|analisis)|labkesda|\bbpom\b|bakteri|{_COLI}|salmonella|nitrit|histamin|penyebab|disebabkan|dipicu|positif|kontaminasi|\bbasi\b"
_LABWORD = r"hasil|\blab\b|laborat|labkesda|\buji\b|pengujian|sampel|bpom|periksa|pemeriksaan"
_WEAK = r"\bhasil\b|\blab\b|laborat|sampel|\buji\b|periksa|pemeriksaan|penyebab|racun"
STRATUM = f"""CASE WHEN {FINDS} THEN 'flag_contamination' WHEN {CLEANS} THEN 'flag_clean' WHEN {AWAITS} THEN 'flag_awaiting'
    WHEN {says("x", _STRONG)} THEN CASE WHEN {says("x", _AGENT)} AND {says("x", _LABWORD)} THEN 'unflagged_high' ELSE 'unflagged_strong' END WHEN {says("x", _WEAK)} THEN 'unflagged_weak' END"""
HEADLINE = f"""coalesce({says("title", rf"{chr(92)}b(?:bakteri|{_COLI}|salmonella|staphylo{chr(92)}w*|nitrit|histamin{chr(92)}w*|positif|mengandung|kontaminasi|terkontaminasi|pemicu|penyebab|biang|terungkap|terbukti|dipastikan|hasil{chr(92)}s+(?:lab|uji|pemeriksaan|laboratorium)|basi|berulat|mentah){chr(92)}b")}
    AND NOT {says("title", rf"{chr(92)}b(?:menunggu|menanti|tunggu|belum|diselidiki|dugaan|diduga|selidiki|telusuri|menelusuri|usut|diuji|cari{chr(92)}s+tahu){chr(92)}b")}, false)"""

HALTED = r"sppg[^.\n]{0,80}(?:dihentikan|ditutup|disetop|dibekukan|ditangguhkan|dinonaktifkan)|(?:menghentikan|menutup|menyetop|membekukan)[^.\n]{0,40}sppg|operasional[^.\n]{0,50}(?:dihentikan|ditutup)"
MECH = {
    "pathogen": _MICROBE,
    "spoilage": r"\b(?:basi|busuk|berlendir|berjamur|berbau|bau\s+tidak\s+sedap|bau\s+menyengat|bau\s+asam|tidak\s+layak\s+konsumsi|rasa\s+aneh|rasa\s+asam|rasa\s+pahit)\b",
    "storage": r"\b(?:dimasak\s+(?:terlalu\s+)?(?:dini|pagi|malam)|jarak\s+waktu|suhu|penyimpanan|disimpan|terlalu\s+lama|waktu\s+distribusi|waktu\s+memasak|waktu\s+penyajian)\b",
    "hygiene": r"\bhigien|\b(?:sanitasi|kebersihan|slhs|sertifikat\s+laik|kontaminasi|terkontaminasi|cuci\s+tangan)\b",
    "utensils": r"\b(?:air\s+tercemar|air\s+kotor|air\s+sumur|air\s+galon|ompreng|alat\s+makan|peralatan|wadah)\b",
    "other_cause": r"\b(?:alergi|alergen|psikologis|psikogenik|histeria|sugesti|kelelahan|sakit\s+sebelumnya)\b",
    "denial": r"\bbukan\s+(?:karena|akibat)\s+(?:mbg|makanan)|\btidak\s+ada\s+(?:hubungan|kaitan)\s+dengan\s+(?:mbg|makanan)",
}
_FOOD = {
    "ayam": "ayam", "telur": "telur", "ikan": "ikan|lele|tuna|cumi|udang", "susu": "susu", "tahu_tempe": "tahu|tempe", "sayur": r"sayur\w*|kol|wortel|buncis|brokoli",
    "buah": "pisang|jeruk|melon|semangka|apel|salak|pepaya|anggur|pir", "daging": "daging|sapi|bakso|sosis|nugget|rendang", "mie": r"mie|mi\s+goreng|spaghetti|bihun", "nasi": "nasi",
}
_DOUBT = r"\b(?:basi|bau|berlendir|berjamur|mentah|kurang\s+matang|asam|pahit|diduga|dicurigai|penyebab|sampel|positif|terkontaminasi|tidak\s+layak|berulat)\b"
_SYMPTOM = {
    "mual": "mual", "muntah": "muntah", "pusing": r"pusing|sakit\s+kepala", "diare": "diare|mencret", "sakit_perut": r"(?:sakit|nyeri|kram)\s+perut|perut\s+(?:sakit|perih|melilit)",
    "lemas": "lemas|lemah", "demam": "demam", "sesak": "sesak", "gatal": "gatal|ruam|biduran", "pingsan": r"pingsan|tidak\s+sadar",
}
_CARES = {"inpatient": r"(?:di)?rawat\s+inap|opname|dirujuk|dilarikan\s+ke\s+(?:rs|rumah\s+sakit)|icu", "outpatient": r"rawat\s+jalan|puskesmas|klinik|pustu"}
_REPLY = {
    "halted": HALTED, "outbreak": r"\bklb\b|kejadian\s+luar\s+biasa", "police": r"\b(?:polisi|polres\w*|polsek|kepolisian|polda|penyidik)\b", "national_agency": r"\bbgn\b|badan\s+gizi\s+nasional",
    "bpom": r"\bbpom\b|badan\s+pengawas\s+obat", "apology": r"(?:minta|memohon|menyampaikan|permohonan|permintaan)\s+maaf",
    "costs": r"(?:biaya|pengobatan|perawatan)[^.\n]{0,60}(?:ditanggung|gratis)|menanggung\s+(?:seluruh\s+)?biaya", "certificate": r"\bslhs\b|sertifikat\s+laik\s+(?:higiene|hygiene)",
    "legislators": r"\bdpr\b|anggota\s+dewan|komisi\s+(?:ix|x)\b", "programme_halt": r"moratorium|(?:hentikan|setop|stop)\s+(?:sementara\s+)?(?:program\s+)?mbg|evaluasi\s+(?:menyeluruh|total|nasional)",
}
_WHO = {
    "health_body": r"dinas\s+kesehatan|\bdinkes|labkesda|laboratorium\s+kesehatan|\bbb?pom\b|balai\s+(?:besar\s+)?pengawas\s+obat|kemenkes|menkes|kementerian\s+kesehatan|\bbtkl\b|puskesmas|\brsud\b|dokter|\bdr\.?\s|epidemiolog|kepala\s+bidang\s+(?:kesehatan|p2p)",
    "programme_operator": r"\bbgn\b|badan\s+gizi|\bsppg\b|satuan\s+pelayanan|satgas\s+mbg|mitra\s+mbg|yayasan|kepala\s+dapur|penyedia",
    "police": r"polres|polsek|polda|polisi|kasat|kepolisian|penyidik|labfor",
    "local_government": r"bupati|wali\s?kota|gubernur|\bwagub\b|wakil\s+(?:bupati|wali)|\bsekda\b|pemkab|pemkot|pemprov|pemda|\bdprd\b",
    "school": r"kepala\s+sekolah|\bkepsek\b|\bguru\b|komite\s+sekolah|pihak\s+sekolah",
}
_WHAT = {
    "E. coli": rf"{_COLI}|escherichia", "Salmonella": "salmonella", "Staphylococcus": "staphylo", "Bacillus": "bacillus", "coliform": "coliform", "nitrite/nitrate": "nitrit|nitrat",
    "histamine": "histamin", "chemical (other)": r"formalin|boraks|pestisida|sianida|logam\s+berat", "virus": "virus", "bacteria (unspecified)": r"\bbakteri\b|kuman",
}
_SUSPECT = lambda p: f"len(list_filter(s, lambda x: {says('x', _DOUBT)} AND {says('x', chr(92) + f'b(?:{p})' + chr(92) + 'b')})) > 0"
INDICATORS = ", ".join(
    [f"{says('text', chr(92) + 'b(?:diduga|dugaan|disinyalir|dicurigai|kemungkinan)' + chr(92) + 'b')} AS hedged_body"]
    + [f"coalesce({says('title', chr(92) + 'b(?:diduga|dugaan|disinyalir|dicurigai|kemungkinan)' + chr(92) + 'b')}, false) AS hedged_title"]
    + [f"{says('text', p)} AS mech_{n}" for n, p in MECH.items()]
    + [f"{says('text', chr(92) + f'b(?:{p})' + chr(92) + 'b')} AS food_{n}" for n, p in _FOOD.items()]
    + [f"{_SUSPECT(p)} AS suspect_{n}" for n, p in _FOOD.items()]
    + [f"{says('text', chr(92) + f'b(?:{p})')} AS sym_{n}" for n, p in _SYMPTOM.items()]
    + [f"{says('text', chr(92) + f'b(?:{p})' + chr(92) + 'b')} AS care_{n}" for n, p in _CARES.items()]
    + [f"{says('text', p)} AS resp_{n}" for n, p in _REPLY.items()]
)
FOODS_SUSPECTED = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {_SUSPECT(p)} THEN '{n}' END" for n, p in _FOOD.items()) + "], lambda z: z IS NOT NULL), '|')"
_NAMED = lambda c, bank: "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {says(c, p)} THEN '{n}' END" for n, p in bank.items()) + "], lambda z: z IS NOT NULL), '|')"


def speakers(c: str) -> str:
    return _NAMED(c, _WHO)


def agents(c: str) -> str:
    return _NAMED(c, _WHAT)
