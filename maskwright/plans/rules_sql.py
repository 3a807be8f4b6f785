r"""The rules as SQL states them, on their own: what the queries are held against does not come from the operators' constants.

RE2 reads ``\b`` as ASCII, as the rules do; ``\s`` is written out.
"""

from __future__ import annotations

# The white space, formats, order, types and confidences of the rules.
_S = r"\t-\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
WS = f"[{_S}]"
_GAP = f"[{_S}.-]"
RULES = {
    "email": ("email", 0.98, r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"),
    "phone_fr": ("phone", 0.9, rf"(?:(?:\+33|0033){_GAP}?[1-9]|0[1-9])(?:{_GAP}?\d{{2}}){{4}}"),
    "phone_intl": ("phone", 0.75, rf"\+\d{{1,3}}(?:{_GAP}?\d{{2,4}}){{2,5}}"),
    "iban": ("iban", 0.85, r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?\b"),
    "nir": ("nir", 0.85, rf"\b[12]{WS}?\d{{2}}{WS}?(?:0[1-9]|1[0-2]|20|30|4\d){WS}?(?:\d{{2}}|2[AaBb]){WS}?\d{{3}}{WS}?\d{{3}}(?:{WS}?\d{{2}})?\b"),
    "date_num": ("date_naissance", 0.35, r"\b(?:0?[1-9]|[12]\d|3[01])[/.-](?:0?[1-9]|1[0-2])[/.-](?:\d{4}|\d{2})\b"),
    "date_lit": ("date_naissance", 0.4, rf"\b(?:0?[1-9]|[12]\d|3[01]){WS}+(?i:janvier|f[ée]vrier|mars|avril|mai|juin|juillet|ao[ûu]t|septembre|octobre|novembre|d[ée]cembre){WS}+\d{{4}}\b"),
    "address": ("postal_address", 0.5, rf"\b\d{{1,4}}(?:{WS}?(?i:bis|ter|quater))?{WS}+(?i:rue|avenue|av\.?|boulevard|bd\.?|impasse|allée|chemin|place|route|quai|square|cours|voie|lieu-dit){WS}+[A-Za-zÀ-ÖØ-öø-ÿŸ0-9'’. -]{{2,60}}"),
    "postal_code": ("postal_code", 0.3, r"\b\d{5}\b"),
    "generic_id": ("custom", 0.25, r"\b[A-Z0-9]{8,20}\b"),  # and a digit and a capital: see KEEP
}
KEEP = {"generic_id": "regexp_matches(x, '[0-9]') and regexp_matches(x, '[A-Z]')"}
_WORD = r"(?:[A-ZÀ-Ý][a-zà-ÿ'’]+|[A-ZÀ-Ý][A-ZÀ-Ý'’]+)"
NAME = rf"\b{_WORD}(?:[{_S}-]+{_WORD}){{1,2}}\b"
NAME_SPLIT = f"[{_S}-]+"
BIRTH = rf"\b(?i:n[ée]e?){WS}+(?i:le{WS}+)?$"
BIRTH_AT_LEAST, INVALID = 0.7, 0.85
BLOCK = 1_000_000_000
STOP = "le la les un une des de du et ou mais donc or ni car ce cette ces cher chère bonjour cordialement merci fait paris france article chapitre annexe section objet note rapport".split()
PLACES = [
    "clermont-ferrand", "saint-étienne", "saint-etienne", "aix-en-provence", "boulogne-billancourt", "saint-denis", "villeneuve-d'ascq", "châlons-en-champagne", "chalons-en-champagne",
    "le havre", "le mans", "la rochelle", "saint-nazaire", "saint-malo", "issy-les-moulineaux", "neuilly-sur-seine", "levallois-perret", "charleville-mézières", "charleville-mezieres",
    "château-thierry", "chateau-thierry",
]
LABELS = {
    "email": "Email", "phone": "Téléphone", "iban": "IBAN", "nir": "Sécurité sociale", "postal_address": "Adresse", "postal_code": "Code postal", "date_naissance": "Date", "date": "Date",
    "name": "Nom / Prénom", "custom": "Identifiant",
}
