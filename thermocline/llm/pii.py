"""Personal data: high-recall span generators, boosted trees on format and context, calibrated thresholds.

Generators propose overlapping spans by pattern. The base kinds (email, ip, card, phone) are decided by
their own checks. The further kinds each have gradient-boosted trees of depth two over binned
features of a candidate's form and of the words around it. They learn from planted texts: sentences of
which it is known what stands in them, true values of each kind and decoys of the same form, so labels
do not come from the features. One half of the planted texts grows the trees, the other calibrates
scores and each kind's threshold; there are as many as `planted` says, whatever the corpus. Candidates,
features, counts and scores are JVM-side functions; only the planted counts come to the driver.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "key", "secret", "iban", "number", "birth", "address", "name")
#: Words that announce a secret, what may stand between such a word and its value, months,
#: titles, words that begin a sentence or a letter and are no part of a name, and a name's part.
SECRET = r"pass(?:word|wd|phrase|code|wort)|(?<=_)pass(?![a-z])|pwd|mot de passe|contraseña|clave|kennwort|secret|token|(?<![a-z])pin(?![a-z])|(?:api|access|private|encryption|signing)[_-]?key"
SAID = r"[A-Za-z0-9_]{0,20}(?:[\x22']?(?:\x20\p{L}{1,12}){0,3}\x20?(?:=>|:=|[=:])\x20?[\x22'`]?|\x20(?:is|was|was set to|set to|ist|lautet|es|est)\x20[\x22'`]?|\x20(?=[^\s]{0,40}[0-9])(?=[^\s]{0,40}\p{L}))"
MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december|januar|februar|märz|mai|juni|juli|oktober|dezember|janvier|février|mars|avril|juin|juillet|août|septembre|octobre|novembre|décembre|enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|octubre|noviembre|diciembre"
TITLES = "Mr|Mrs|Ms|Miss|Dr|Prof|Sir|Herr|Herrn|Frau|Monsieur|Madame|Mme|Mlle|Señor|Señora|señor|señora|monsieur|madame|Don|Doña|don|doña"
LEADS = TITLES + "|Dear|Hi|Hello|Contact|Signed|Regards|From|To|By|With|The|A|An|In|On|At|And|But|Or|My|Our|His|Her|Their|Your|He|She|They|We|I|It|This|That|These|Those|When|While|After|Before|If|As|For|Ask|Call|Meet|See|Yesterday|Today|Tomorrow|Now|Then|Here|There|Since|Until|Please|Thanks|Heute|Gestern|Morgen|Heut|Hier|Demain|Ayer|Hoy|Liebe|Lieber|Hallo|Der|Die|Das|Ein|Eine|Und|Aber|Mein|Meine|Unser|Unsere|Kollege|Von|Mit|Im|Am|Cher|Chère|Bonjour|Le|La|Les|Un|Une|Et|Mais|Mon|Ma|De|Du|Des|Querido|Querida|Estimado|Estimada|Hola|El|Los|Las|Y|Pero|Mi|Su|En"
PART = r"\p{Lu}(?:['’]\p{Lu})?\p{Ll}{1,20}(?:(?<=Mc|Mac|Fitz)\p{Lu}\p{Ll}{1,20})?"
#: Each finds the leftmost non-overlapping matches; possessive, and begun only where a match can begin,
#: so that time is linear in the text. \\G: where the last match ended.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "key": r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{16,}+",
    "secret": rf"((?iu:{SECRET})(?:{SAID}))([^\s,;\x22'`&<>]*[^\s,;=:.!?)\x22'`&<>])|(://[^\s/:@]{{1,40}}:)([^\s/:@]{{1,60}})(?=@)",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "number": r"(?<![A-Za-z0-9./-]|[0-9]\x20)(?:[A-Z]{2}\x20?[0-9]{2}\x20[0-9]{2}\x20[0-9]{2}\x20[A-D]|[A-Z][0-9][0-9A-Z]{5,8}|[0-9]{2}[A-Z]{2}[0-9]{5}|[A-Z]{0,2}[0-9](?:[\x20./-]?+[0-9]){5,}+(?:-?[A-Z])?)(?![A-Za-z0-9])",
    "birth": rf"(?<![0-9./-])(?:[0-9]{{1,2}}[./-][0-9]{{1,2}}[./-][0-9]{{4}}|[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{1,2}}(?:\.|st|nd|rd|th|er)?\x20(?:de\x20|of\x20)?(?iu:{MONTHS})\.?,?\x20(?:de\x20|del\x20)?[0-9]{{4}}|(?iu:{MONTHS})\x20[0-9]{{1,2}}(?:st|nd|rd|th)?,?\x20[0-9]{{4}})(?![0-9])",
    "address": r"(?<![\p{L}0-9])(?:[0-9]{1,5}[a-z]?\x20(?:\p{Lu}(?:\p{Ll}{1,20}|\.)\x20){1,3}(?:Street|Road|Avenue|Lane|Drive|Boulevard|Court|Place|Square|Terrace|Close|Crescent|Parkway|Highway|Way|(?:St|Rd|Ave|Ln|Dr|Blvd|Ct|Pl|Sq|Pkwy)(?:\.(?=,|\x20[\p{Ll}0-9]))?)(?!\p{L})"
    r"|[0-9]{1,4}(?:\x20bis|\x20ter)?,?\x20(?:rue|avenue|boulevard|place|quai|chemin|impasse|allée|route|cours)\x20(?:(?:de|du|des|la|le|les)\x20|[ld]['’])*+\p{Lu}\p{Ll}{1,20}(?:[\x20-]\p{Lu}\p{Ll}{1,20}){0,3}"
    r"|\p{Lu}\p{Ll}{1,30}(?:straße|strasse|str\.|weg|platz|gasse|allee|ring|damm|ufer)\x20[0-9]{1,4}(?:\x20?[a-z])?(?![\p{L}0-9])|\p{Lu}\p{Ll}{1,20}\x20(?:Straße|Strasse|Str\.|Weg|Platz|Gasse|Allee|Ring|Damm|Ufer)\x20[0-9]{1,4}(?:\x20?[a-z])?(?![\p{L}0-9])"
    r"|(?:[Cc]alle|[Aa]venida|[Aa]vda\.|[Pp]laza|[Pp]aseo|[Cc]amino|[Rr]onda)\x20(?:(?:de|del|la|las|los|el)\x20)*+\p{Lu}\p{Ll}{1,20}(?:\x20(?:de\x20)?\p{Lu}\p{Ll}{1,20}){0,2},?\x20(?:n[ºo°]\.?\x20)?[0-9]{1,4}(?![0-9]))",
    "name": rf"(?<![\p{{L}}'’-])(?!(?:{LEADS})(?!\p{{L}}))(?:{PART}(?:[\x20-](?:(?:van|von|der|den|de|la|del|di|da|du|zu)\x20){{0,2}}(?:{PART}|\p{{Lu}}\.(?=\x20\p{{Lu}}))){{1,3}}|(?<=(?:{TITLES})\.?\x20){PART})(?!\p{{L}})",
}
NEEDED = {"email": "@", "phone": "+"} | {k: "0123456789" for k in ("ip", "card", "iban", "number", "birth", "address")}
#: Words that speak of a kind, in four languages, just before or after a candidate.
CUES = {
    "credential": "password|passwd|pwd|passwort|kennwort|contraseña|mot de passe|secret|token|api.?key|access.?key|key|keys|credentials?|login|auth|bearer|authorization|rotate|revoke|leaked|clé|jeton|schlüssel|zugang|clave|llave|acceso|accès",
    "bank": "iban|account|konto|kontonummer|cuenta|compte|bank|bic|rib|virement|überweisung|überweisen|transfer|wire|pay|payee|deposit|refund|donations?|spenden|miete|rent|salary|banco|transferencia",
    "identity": "ssn|social|social security|passport|reisepass|personalausweis|personalausweisnummer|ausweis|dni|nif|nie|passeport|sécurité sociale|identité|identity|tax|taxpayer|tax.?id|steuernummer|steuer-id|driver.?s licen[cs]e|driving licen[cs]e|licen[cs]e|national id|insurance|ni|medicare|sozialversicherungsnummer|id card",
    "born": "born|birth|birthday|birthdate|dob|d.o.b|geboren|geburtsdatum|geburtstag|geb|né|née|naissance|nacido|nacida|nació|nacimiento|nac|b",
    "person": "mr|mrs|ms|miss|dr|prof|herr|frau|monsieur|madame|mme|señor|señora|sr|sra|don|doña|dear|hi|hello|name|named|nombre|nom|contact|patient|paciente|signed|sincerely|regards|wishes|liebe|lieber|kollege|estimado|cher|chère|ami|amie|amigo|amiga|brother|sister|mother|father|uncle|aunt|neighbou?r|friend|wife|husband|doctor|employee|customer|tante|onkel|bruder|schwester|vecino|vecina|hermano|hermana|interview|according to",
    "speaks": "said|says|told|wrote|asked|added|called|met|thinks|sagte|sagt|meint|dit|disait|parlais|dijo|llamó|firmó|signé|arrive|kommt",
    "place": "live|lives|lived|living|address|adresse|anschrift|dirección|domicilio|domicile|wohnt|wohnhaft|wohne|habite|demeurant|loge|vive|vivo|vivimos|casa|house|home|haus|flat|apartment|office|büro|bureau|ship|deliver|send|sent|parcel|paket|mail|moved|resides|situated",
    "other": "order|invoice|version|isbn|issn|doi|ref|reference|ticket|page|chapter|commit|build|sha|hash|checksum|model|part|item|serial|batch|bestellung|rechnung|commande|facture|pedido|factura|class|method|function",
    "dated": "released|published|updated|posted|since|until|council|veröffentlicht|publié|publicado|held|opened",
}
#: Beginnings of issued keys; lengths of account numbers by country; common given names; words of names that are no person's.
ISSUED = "AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|xox[abeprs]-|sk[_-](?:live|test|proj)|rk_live|AIza|npm_|hf_|SG[._]|whsec_|eyJ|ya29"
ACCOUNTS = "NO13|BE14|DK16|FI16|NL16|SI17|AT18|EE18|LT18|LU18|CH19|HR19|LI19|LV19|BG20|DE20|GB20|IE20|CZ22|ES22|RO22|SA22|SE22|SK22|PT23|IS24|TR24|FR25|GR25|IT25|MC25|SM25|CY26|HU26|PL26|MT29"
GIVEN = "James|Mary|John|Patricia|Robert|Jennifer|Michael|Linda|William|Elizabeth|David|Barbara|Richard|Susan|Joseph|Jessica|Thomas|Sarah|Charles|Karen|Daniel|Lisa|Matthew|Nancy|Anthony|Margaret|Mark|Sandra|Paul|Ashley|Steven|Emily|Andrew|Donna|Joshua|Michelle|Kevin|Carol|Brian|Amanda|George|Laura|Edward|Emma|Henry|Olivia|Alice|Anna|Peter|Petra|Hans|Ursula|Karl|Monika|Klaus|Sabine|Wolfgang|Helga|Jürgen|Renate|Stefan|Claudia|Andreas|Julia|Martin|Katharina|Jean|Marie|Pierre|Nathalie|Michel|Isabelle|Philippe|Sylvie|Alain|Catherine|Nicolas|Camille|Antoine|Claire|Louis|Chloé|José|María|Maria|Antonio|Carmen|Manuel|Ana|Francisco|Isabel|Juan|Dolores|Javier|Pilar|Carlos|Teresa|Miguel|Lucía|Lucia|Luis|Marta|Pedro|Elena|Pablo|Sofía|Sofia|Alberto|Rosa|Benjamin|Samuel|Rachel|Hannah|Liam|Noah|Grace|Jack|Lucy|Harry|Sophie|Oliver|Ruth|Simon|Eva|Max|Lena|Ingrid|Heinz|Lucas|Hugo|Jules|Inès"
PUBLIC = "North|South|East|West|New|Old|Great|Golden|Grand|United|National|Royal|Central|High|Supreme|First|Second|Third|Last|Happy|Street|Road|City|River|Lake|Bridge|Park|Hotel|Station|University|College|School|Church|Museum|Bank|Banque|Banco|Court|Council|Company|Group|Team|Club|Service|Office|States|Kingdom|Republic|America|Europe|York|Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday|Morning|Night|Year|Day|January|February|March|April|June|July|August|September|October|November|December|World|War|Peace|Open|Source|Word|Reader|Deutsche|Bahn|Alte|Neue|Markt|Gran|Vía|Champs|Tour|Floor|Room|Customer"
FEATURES = ("length", "digits", "uppers", "lowers", "marks", "groups", "switches", "vowels", "form", "before", "after", *CUES)
#: Marks of matches; a text's own ones are replaced by a character that no pattern tells from them.
BEGIN, END, STAND_IN = "\u0001", "\u0002", "\u0003"
ROUNDS, RATE, PRECISION, PLANTED, DECOYS = 25, 0.4, 0.9, 16_000, 10


def marked(text: Column, kind: str) -> Column:
    """The text cut before each match of the kind; a match's end is marked. One pass over the text, none where no match can be."""
    group = f"$1$3{BEGIN}$2$4{END}" if kind == "secret" else f"{BEGIN}$0{END}"
    cut = F.split(F.regexp_replace(text, PATTERNS[kind], group), BEGIN)
    return F.when(reduce(lambda a, c: a | c, [text.contains(x) for x in NEEDED[kind]]), cut).otherwise(F.array(text)) if kind in NEEDED else cut


def proposals(pieces: Column, kind: str) -> Column:
    """array<struct<kind,gap,m,before,after>> of a column made by marked(): gap is the length of the text since the last match of the kind.

    Of a secret the value alone is m; its key word is in the gap.
    """
    n = F.size(pieces) - 1

    def near(last: Column, own: Column) -> Column:
        lead, rest = F.substring_index(last, END, -1), F.substring_index(own, END, -1)
        return F.struct(F.lit(KINDS.index(kind)).alias("kind"), F.length(lead).alias("gap"), F.substring_index(own, END, 1).alias("m"), F.right(lead, F.lit(40)).alias("before"), F.left(rest, F.lit(16)).alias("after"))

    return F.zip_with(F.slice(pieces, F.lit(1), n), F.slice(pieces, F.lit(2), n), near)


def passes(m: Column) -> dict[str, Column]:
    """The checks of the base kinds."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    n = F.length(digits)
    part = r"0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
    each = F.transform(F.reverse(F.filter(F.split(digits, ""), lambda d: d != "")), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    luhn = F.aggregate(each, F.lit(0), lambda a, d: a + d) % 10 == 0
    return {"email": F.lit(True), "ip": m.rlike(rf"^{part}(?:\.{part}){{3}}$"), "card": F.when(n.between(13, 19), luhn).otherwise(False), "phone": n.between(9, 15)}


def forms(m: Column) -> dict[str, Column]:
    """What a candidate's own form tells of its kind, as a small number."""
    solid = F.regexp_replace(m, "[^A-Z0-9]", "")
    length = reduce(lambda x, a: x.when(m.startswith(a[:2]), int(a[2:]) + 2), ACCOUNTS.split("|"), F.when(F.lit(False), 0)).otherwise(-1)
    return {
        "key": F.when(m.rlike(f"^(?:{ISSUED})"), 2).when(m.rlike("^[0-9a-f]{32,}$"), 1).otherwise(0),
        "secret": m.rlike("[0-9]").cast("int") + m.rlike(r"\p{L}").cast("int") + 2 * m.rlike(r"\p{Ll}\p{Lu}|[!#$%&/@_+]").cast("int"),
        "iban": (F.length(solid) == length).cast("int"),
        "number": F.when(m.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), 3).when(m.rlike("^[A-Z]{2}[ 0-9]+[A-D]$"), 2).when(m.rlike("^(?:[0-9]{8}[A-Z]|[XYZ][0-9]{7}[A-Z])$"), 1).otherwise(0),
        "birth": F.greatest(F.lit(0), F.least(F.lit(13), F.floor((F.regexp_extract(m, "[0-9]{4}", 0).try_cast("int") - 1900) / 10))),
        "address": F.when(m.rlike("(?:First|Second|Third|Fourth|Last|Only|Great|Best) (?:Place|Way|Court|Drive)$"), 0).otherwise(1),
        "name": F.when(m.rlike(rf"(?<!\p{{L}})(?:{PUBLIC})(?!\p{{L}})"), 0).when(m.rlike(rf"^(?:{GIVEN})(?!\p{{L}})"), 2).otherwise(1),
    }


def candidates(documents: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """row, doc_id and a candidate per line (kind null where a row has none): start, end, ok, m's features."""
    whole = F.coalesce(F.col(text), F.lit(""))
    whole = F.when(whole.contains(BEGIN) | whole.contains(END), F.translate(whole, BEGIN + END, STAND_IN * 2)).otherwise(whole)
    rows = documents.select(F.monotonically_increasing_id().alias("row"), F.col(doc).alias("doc_id"), whole.alias("whole"))
    rows = rows.select("row", "doc_id", *[marked(F.col("whole"), k).alias(f"cut_{k}") for k in KINDS])
    rows = rows.select("row", "doc_id", F.concat(*[proposals(F.col(f"cut_{k}"), k) for k in KINDS]).alias("all"))
    each = rows.select("row", "doc_id", F.posexplode_outer("all").alias("i", "x")).select("row", "doc_id", "i", "x.*")
    m, before, after, kind = F.col("m"), F.col("before"), F.col("after"), F.col("kind")
    count = lambda chars: F.length(F.regexp_replace(m, f"[^{chars}]", ""))
    share = lambda chars: F.floor(count(chars) * 4 / F.greatest(F.length("m"), F.lit(1)))
    checks = passes(m)
    ok = reduce(lambda a, k: a.when(kind == KINDS.index(k), checks[k]), BASE, F.when(F.lit(False), F.lit(False))).otherwise(False)
    learned = kind >= len(BASE)
    form = reduce(lambda x, f: x.when(kind == KINDS.index(f[0]), f[1]), forms(m).items(), F.when(F.lit(False), 0)).otherwise(0)
    letters = F.length(F.regexp_replace(m, r"[^\p{L}]", ""))
    vowels = F.length(F.regexp_replace(F.lower("m"), "[^aeiouyáéíóúàèâêîôûäöü]", ""))
    bins = {
        "length": F.least(F.floor(F.length("m") / 2), F.lit(20)),
        "digits": share("0-9"),
        "uppers": share("A-Z"),
        "lowers": share("a-z"),
        "marks": F.least(F.length(F.regexp_replace(m, r"[\p{L}0-9]", "")), F.lit(5)),
        "groups": F.least(F.size(F.split(m, r"[^\p{L}0-9]+")), F.lit(5)),
        "switches": F.least(F.length(F.regexp_replace(m, "(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])", "-")) - F.length("m"), F.lit(8)),
        "vowels": F.floor(vowels * 8 / F.greatest(letters, F.lit(1))),
        "form": form,
        "before": F.when(before == "", 0).when(before.rlike(r"[.!?]\s+$|\n\s*$"), 1).when(before.rlike(r"[=:]\s?$"), 2).when(before.rlike(r"[\p{L}],?\s$"), 3).otherwise(4),
        "after": F.when(after == "", 0).when(after.rlike(r"^[.,;:!?)\n]"), 1).when(after.rlike(r"^\s\p{Ll}"), 2).otherwise(3),
    } | {name: F.lower(F.concat(before, F.lit(" \u0001 "), after)).rlike(rf"(?<!\p{{L}})(?:{words})(?!\p{{L}})").cast("int") for name, words in CUES.items()}
    each = each.select("row", "doc_id", "i", "kind", "gap", F.length("m").alias("long"), ok.alias("ok"), *[F.when(learned, v.cast("int")).otherwise(0).alias(k) for k, v in bins.items()])
    along = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = each.repartition("row").withColumn("end", F.sum(F.col("gap") + F.col("long")).over(along)).withColumn("start", F.col("end") - F.col("long"))
    return each.select("row", "doc_id", "kind", "start", "end", "ok", *FEATURES)


def boost(x: np.ndarray, kind: np.ndarray, n: np.ndarray, pos: np.ndarray, rounds: int = ROUNDS, rate: float = RATE) -> list:
    """Trees of depth two [(feature, bin, left, right)...]: (feature, at most bin) leads left; by Newton steps.

    Feature 0 is the kind. Rows are feature combinations with n candidates, pos of them positive.
    """
    x = np.column_stack([kind, x])
    f, trees = np.zeros(len(x)), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-f))
        g, h = pos - n * p, n * p * (1 - p)

        def best(rows: np.ndarray, g=g, h=h) -> tuple | None:
            found = None
            for j in range(x.shape[1]):
                for b in np.unique(x[rows, j])[:-1]:
                    left = rows & (x[:, j] <= b)
                    right = rows & ~left
                    gain = g[left].sum() ** 2 / (h[left].sum() + 1) + g[right].sum() ** 2 / (h[right].sum() + 1)
                    if found is None or gain > found[0]:
                        found = (gain, j, int(b), left, right)
            return found

        def leaf(rows: np.ndarray, g=g, h=h) -> float:
            return float(rate * g[rows].sum() / (h[rows].sum() + 1))

        def grow(rows: np.ndarray, depth: int):
            cut = best(rows) if depth else None
            if cut is None:
                value = leaf(rows)
                f[rows] += value
                return value
            return (cut[1], cut[2], grow(cut[3], depth - 1), grow(cut[4], depth - 1))

        trees.append(grow(np.ones(len(x), bool), 2))
    return trees


def expression(tree) -> Column:
    """A tree as nested conditions."""
    if not isinstance(tree, tuple):
        return F.lit(tree)
    feature, b, left, right = tree
    return F.when(F.col(("kind", *FEATURES)[feature]) <= b, expression(left)).otherwise(expression(right))


def margin(trees: list, x: np.ndarray) -> np.ndarray:
    """The sum of the trees' leaves for each row of x."""

    def leaves(tree) -> np.ndarray:
        return np.where(x[:, tree[0]] <= tree[1], leaves(tree[2]), leaves(tree[3])) if isinstance(tree, tuple) else np.full(len(x), tree)

    return sum(map(leaves, trees), np.zeros(len(x)))


def announced(cue: str, *joints: str) -> list[str]:
    """Contexts of a value: each word of the cue (but patterns) with each joint."""
    return [w + j for w in CUES[cue].split("|") if "." not in w and "?" not in w for j in joints]


#: What planted sentences are made of. Per kind: (true values, contexts of true values,
#: decoys, contexts of decoys). In a value # is a digit, @ a capital, ~ a small letter, ^ a digit or one
#: of a to f, ? a digit or letter.
ALONE = ["{}", "so {} it is", "and {} too", "we saw {} there", "y {} también", "und {} auch", "puis {} encore", "with {}, again", "x = \"{}\"", "({})", "-> '{}' of"]
ISSUED_SHAPES = ["AKIA" + "?" * 16, "ASIA" + "?" * 16, "ghp_" + "?" * 36, "sk_live_" + "?" * 24, "sk-proj-" + "?" * 28, "AIza" + "?" * 35, "glpat-" + "?" * 20, "xoxb-############-" + "?" * 20, "npm_" + "?" * 36, "hf_" + "?" * 34]
LOOSE_SHAPES = ["^" * 32, "^" * 40, "?" * 22, "?" * 32, "?" * 24]
SURNAMES = ["Miller", "Baker", "Schmidt", "Garcia", "Dubois", "Weber", "Torres", "Green", "Fischer", "Lambert", "Wagner", "Serrano", "Mercier", "Hill", "Wood", "Krüger", "Castillo", "Fontaine", "Murphy", "Becker", "O'Neil", "McKay", "Iglesias", "Kaya", "Rossi", "Novak", "Sato", "Singh"]
RARE = ["Tamsin", "Ottilie", "Yusuf", "Ayako", "Bastian", "Ximena", "Corentin", "Dmitri", "Nneka", "Svenja", "Gaspar", "Maëlle"]
PLANT = {
    "key": (
        ISSUED_SHAPES * 2 + LOOSE_SHAPES * 2,
        announced("credential", ": {}", " {}", " is {}", "={}", " {} was found", " \"{}\"", " {}\"") * 2 + ["in the log {}", "{} please"] + ALONE * 20,
        ["~~~~~~~_~~~~~_~~~~~~", "~~~~~~~~~~~~~~~~~~", "@~~~~~~~@~~~~~~~@~~~", "~~~_~~~~~~_####_~~~~~~", "####################", "@@@@@@_@@@@@@@@_@@@@", "~~~~-~~-~~~-~~~~~", "~~~~~~~-~~~~~~~~-~~~~~", "----------------", "########-####-####", "get_user_by_name_or_id", "AbstractFactoryManagerBean", "well-established-tradition", "counterrevolutionaries"] + ["^" * 40, "^" * 32],
        ["the method {} is called", "see {} in the code", "{} is a long word", "the commit {} shows", "build {} passed", "checksum {} fits", "hash {} of it", "by sha {} alone"] + ALONE,
    ),
    "secret": (
        ["~~~#~~#~", "?????#?????", "@~~~~~##!x", "?#??????#????", "~#~~##~#~#~~#~##~~#~#~##~#~~#~#~", "~~~~~##", "~~~~~####", "@~~~~####", "@~~~~_##", "~~~#~~~~~@~~~", "^^^^^^^^^^^^", "^" * 32, "^" * 40, "????/?????/???????", "?####?", "~#~~-~~##", "##~~~~##~~~", "?" * 12 + "/" + "?" * 27, "?" * 20 + "+" + "?" * 19],
        ["password: {}", "pwd={}", "token = {}", "secret: {}", "passwort: {}", "API_KEY={}", "token = \"{}\"", "password: '{}'", "the pin is {} now", "clave = {}", "kennwort ist {} dort", "mot de passe = {}", "contraseña: {}", "x_secret=\"{}\"", "passcode {} opens it", "signing_key: {}", "ftp://someone:{}@files.example", "token for us: {}", "password of mine = {}"],
        ["None", "null", "true", "the", "see", "required", "****", "unknown", "string", "~~~~~~", "~~~~", "~~~~~~~~~", "not", "a", "hidden", "str", "#"],
        ["password: {}", "token = {} below", "secret: {} page", "pwd={}", "passwort: {}", "token = \"{}\"", "password: '{}'", "the secret is {} to us", "a token is {} here", "password is {} for", "clave es {} hoy", "secrets are: {}"],
    ),
    "iban": (
        ["DE## #### #### #### #### ##", "DE####################", "FR## #### #### #### #### #### ###", "FR## #### #### #### #### #@## ###", "FR#########################", "GB##@@@@##############", "GB## @@@@ #### #### #### ##", "ES######################", "ES## #### #### #### #### ####", "NL## @@@@ #### #### ##", "BE## #### #### ####", "AT## #### #### #### ####", "CH## #### #### #### #### #", "IT## @### #### #### #### #### ###", "PL## #### #### #### #### #### ####"],
        announced("bank", ": {}", " {}", " is {}", " to {}") + ALONE * 3,
        ["AB## CDEF ####", "XK##@@@@####", "MX## SERI ALNO ####", "QX## #### ####", "AA########", "RT##AB##CD##", "ZZ## AB## AB##"],
        announced("other", " {}", ": {}") + ALONE,
    ),
    "number": (
        ["###-##-####"] * 3 + ["########@"] * 2 + ["@#######@", "## ### ### ###", "#########", "##########", "########", "###########", "@########", "##@@#####", "@@ ## ## ## A", "@@ ## ## ## C", "@##@##@##", "@#@@####@", "@@######@", "# ## ## ## ### ### ##", "##-#######"],
        announced("identity", ": {}", " {}", " is {}", " no. {}", " number {}", " nr. {}"),
        ["####-####", "######", "##.##.####.##", "#########", "###-#-##-######-#", "##########", "########", "####-#####", "# ### ###", "#.#############", "###-##-#####", "@#######", "@@######"],
        announced("other", " {}", " {} was shipped", " no. {}", ": {}") + ["the value {} was", "{} people", "about {} of them"] + ALONE,
    ),
    "birth": (
        ["##/##/19##", "##.##.19##", "19##-##-##", "##-##-19##", "May #, 19##", "# June 19##", "## December 19##", "August ##, 19##", "#. März 19##", "##. September 19##", "# avril 19##", "## novembre 19##", "# de enero de 19##", "## de julio de 19##"],
        announced("born", ": {}", " {}", " on {}", " am {} in", " le {} à", " el {} en", " ({})", ", {}"),
        ["##/##/20##", "##.##.20##", "20##-##-##", "##.##.19##", "##/##/19##", "# June 19##", "May #, 19##", "# de enero de 18##", "## novembre 18##", "#. März 19##", "## December 19##"],
        announced("dated", " {}", " on {}", ": {}") + ["invoice of {}", "am {} war", "le {} il", "on {} they", "el {} hubo"] + ALONE,
    ),
    "address": (
        ["## Maple Street", "### Old Mill Road", "#### Ocean Drive", "## Hazel Ave.", "### North Lincoln Blvd", "# Orchard Lane", "## Saint Mary Terrace", "# Castle Square", "### Beech Crescent", "## Fern Close", "## rue de Lyon", "# bis, rue du Moulin", "##, avenue Jean Jaurès", "## quai de Seine", "##, place Bellecour", "Gartenstraße ##", "Lindenweg #", "Rosenstr. ##", "Neuer Weg ##", "Lange Straße #", "Eichenallee ##", "Domplatz #", "calle Luna, ##", "calle de Toledo ##", "Avenida del Puerto ##", "Plaza Nueva #", "paseo del Prado, ##"],
        announced("place", " {}", " at {}", ": {}", " in {}", " in der {}", " en {}") + ALONE * 20,
        ["# First Place", "## Second Place", "# Great Way", "## Third Place", "# Only Way"],
        ["took {} then", "the {} winners", "in {} finish", "{} prize", "won {} again"],
    ),
    "name": (
        [f"{g} {n}" for g, n in zip(GIVEN.split("|") * 2, SURNAMES * 20)] + [f"{g} {n}" for g, n in zip(RARE * 6, SURNAMES * 3)] + SURNAMES * 2,
        announced("person", " {}", ": {}", ", {}", ". {}", " {},") * 2 + ["{} " + w + " so" for w in CUES["speaks"].split("|")] * 3 + ALONE * 12,
        ["New York", "United States", "South America", "Open Source", "Hard Drive", "Black Forest", "Red Square", "Mount Etna", "Big Data", "Green Tea", "Machine Learning", "Data Science", "Visual Studio", "Air France", "Buenos Aires", "Schwarze Pumpe", "Rote Fahne", "Casa Blanca", "Plan Maestro", "Grands Boulevards", "@~~~~~ @~~~~", "@~~ @~~~~~~", "@~~~~~~ @~~~~~~~~", "Royal Mail", "First Aid", "Happy Hour", "Monday Club", "Central Park", "Deutsche Post", "Banco Rojo", "High Tide", "Royal Navy", "United Front", "Golden Eagle", "City Hall", "North Sea", "Grand Prix", "Old Bridge", "River Club", "National Theatre", "World Cup", "Supreme Team", "Sunday Night", "Last Day", "Great Lake", "Second Floor"],
        ["{} is large", "in {} they", "we saw {} there", "{} war gut", "and {} came", "{} fue grande", "from {} on", "the {} of it", "{}", "visit {} soon", "like {} or", "with {}, again", "{} opened", "read {}."] + ["{} " + w + " so" for w in CUES["speaks"].split("|")[::3]],
    ),
}
FILLERS = ["", "It is so. ", "and then ", "we note that ", "Heute ist es gut. ", "Il fait beau. ", "a line\n", "1999 was good, ", "Todo va bien, "]


def planted(spark: SparkSession, rows: int = PLANTED, seed: int = 5) -> DataFrame:
    """row, text, kind, start, end, is_true: sentences with one value each, as many of every kind and of both sorts."""
    pick = lambda options, salt: F.element_at(F.array(*map(F.lit, options)), (F.pmod(F.xxhash64("id", F.lit(salt), F.lit(seed)), F.lit(len(options))) + 1).cast("int"))
    letters = {"#": "0123456789", "@": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "~": "abcdefghijklmnopqrstuvwxyz"}
    letters |= {"?": "".join(letters.values()), "^": "0123456789abcdef"}
    kinds = [k for k in KINDS if k in PLANT]
    sort = F.pmod("id", F.lit(2 * len(kinds)))
    shape, context = F.lit(""), F.lit("")
    for n, k in enumerate(kinds):
        for true in (1, 0):
            own = sort == 2 * n + 1 - true
            shape, context = F.when(own, pick(PLANT[k][0 if true else 2], 1)).otherwise(shape), F.when(own, pick(PLANT[k][1 if true else 3], 2)).otherwise(context)
    base = spark.range(rows).select("id", shape.alias("shape"), context.alias("context"), F.floor(sort / 2).cast("int").alias("n"), (F.pmod("id", F.lit(2)) == 0).alias("is_true"), pick(FILLERS, 3).alias("first"), pick(FILLERS, 4).alias("last"))

    def letter(c: Column, i: Column) -> Column:
        draw = F.pmod(F.xxhash64("id", i, F.lit(seed)), F.lit(1 << 30))
        return reduce(lambda x, mark: x.when(c == mark, F.substring(F.lit(letters[mark]), (F.pmod(draw, F.lit(len(letters[mark]))) + 1).cast("int"), F.lit(1))), letters, F.when(F.lit(False), c)).otherwise(c)

    end = pick([". ", ". ", "\n", ", ", ""], 5)
    tail = F.when(end == "", "").otherwise(F.concat(end, "last"))  # some values end their text
    value = F.array_join(F.transform(F.filter(F.split("shape", ""), lambda c: c != ""), letter), "")
    base = base.withColumn("value", value).withColumn("lead", F.concat("first", F.substring_index("context", "{}", 1)))
    number = F.element_at(F.array(*[F.lit(KINDS.index(k)) for k in kinds]), F.col("n") + 1)
    return base.select(F.col("id").alias("row"), F.concat("lead", "value", F.substring_index("context", "{}", -1), tail).alias("text"), number.alias("kind"), F.length("lead").alias("start"), (F.length("lead") + F.length("value")).alias("end"), "is_true")


def fit(spark: SparkSession, rows: int = PLANTED, precision: float = PRECISION, seed: int = 5) -> dict[int, tuple[list, float, float, float]]:
    """By kind (trees, calibration slope and offset, least calibrated score) from planted texts.

    A candidate is positive if it is a planted true value of its kind. Thresholds are the least scores
    of 0.5 or more from which on the held-out half reaches the precision, each decoy counted DECOYS
    times, as a corpus holds that many more of them; kinds that never do add nothing.
    """
    told = planted(spark, rows, seed)
    found = candidates(told, "row").select("doc_id", "start", "end", *[F.col(c).alias(c) for c in ("kind", *FEATURES)]).where(F.col("kind") >= len(BASE))
    truth = told.where("is_true").select(F.col("row").alias("doc_id"), "kind", "start", "end", F.lit(1).alias("hit"))
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    counts = found.join(truth, ["doc_id", "kind", "start", "end"], "left").groupBy("kind", *FEATURES, fold.alias("fold")).agg(F.count("*").alias("n"), F.count("hit").alias("pos"))
    data = np.array(sorted(map(list, counts.collect())), float)  # at most a line for each planted candidate
    return {k: model for k in range(len(BASE), len(KINDS)) if (model := calibrated(data[data[:, 0] == k], precision))}


def calibrated(data: np.ndarray, precision: float) -> tuple[list, float, float, float] | None:
    """fit()'s model of one kind, from rows of kind, features, fold, n and pos; None if it never reaches the precision."""
    fold, n, pos, x = data[:, -3], data[:, -2], data[:, -1], data[:, : 1 + len(FEATURES)]
    learn, test = fold == 0, fold == 1
    trees = boost(x[learn, 1:], x[learn, 0], n[learn], pos[learn])
    m = margin(trees, x)
    a, b = 1.0, 0.0
    for _ in range(50):  # Platt scaling on the held-out half, by Newton's method
        p = 1 / (1 + np.exp(-np.clip(a * m[test] + b, -30, 30)))
        w, e = n[test] * p * (1 - p), n[test] * p - pos[test]
        hess = np.array([[(w * m[test] ** 2).sum() + 1e-2, (w * m[test]).sum()], [(w * m[test]).sum(), w.sum() + 1e-2]])
        move = np.linalg.solve(hess, [(e * m[test]).sum() + 1e-2 * (a - 1), e.sum()])
        a, b = a - np.clip(move[0], -1, 1), b - np.clip(move[1], -1, 1)
    p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
    for cut in np.unique(p[test & (p >= 0.5)]):
        over = test & (p >= cut)
        true = pos[over].sum()
        if true and true >= precision * (true + DECOYS * (n[over].sum() - true)):
            return trees, float(a), float(b), float(cut) - 1e-9
    return None


def scan(documents: DataFrame, doc: str = "doc_id", text: str = "text", precision: float = PRECISION) -> DataFrame:
    """One row per row of documents: doc_id and spans array<struct<kind,start,end,score,base>>.

    kind is a number into KINDS; start and end are code points, end exclusive. Base spans are always
    there; the others where the calibrated score reaches their kind's threshold. Null and empty texts
    have none; repeated rows keep a row each; whole texts; other columns are not read.
    """
    models = fit(documents.sparkSession, precision=precision)
    found = candidates(documents, doc, text)
    nothing, kind = F.when(F.lit(False), F.lit(0.0)), F.col("kind")
    margins = reduce(lambda x, k: x.when(kind == k, models[k][1] * reduce(lambda s, t: s + t, map(expression, models[k][0])) + models[k][2]), models, nothing)
    least = reduce(lambda x, k: x.when(kind == k, F.lit(models[k][3])), models, nothing)
    score = 1 / (1 + F.exp(-margins.otherwise(0.0)))
    enough = F.coalesce(F.col("score") >= least, F.lit(False))
    taken = F.when(F.col("ok") | enough, F.struct("kind", "start", "end", "score", F.col("ok").alias("base")))
    return found.withColumn("score", score).withColumn("span", taken).groupBy("row", "doc_id").agg(F.array_sort(F.collect_list("span")).alias("spans")).drop("row")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span (start, end) replaced by [KIND]; overlapping spans are one."""
    step = lambda acc, s: F.when(
        s["start"] >= acc["at"], F.struct(F.concat(acc["out"], F.substring(text, acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int")), F.lit("["), F.upper(F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)), F.lit("]")).alias("out"), s["end"].alias("at"))
    ).otherwise(F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["end"]).alias("at")))
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].cast("long").alias("start"), s["end"].cast("long").alias("end"), s["kind"].alias("kind"))))
    done = F.aggregate(order, F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")), step)
    return F.concat(done["out"], F.substring(text, done["at"].cast("int") + 1, F.length(text)))


def query(spark, sf_dir: str) -> DataFrame:
    """op5: the contract's digest of scan() over all documents."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    names = F.array(*map(F.lit, KINDS))
    said = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])
    base = F.filter("spans", lambda s: s["base"])
    number = lambda k: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == k))).cast("long")
    return found.select("doc_id", *[number(k).alias(f"n_{name}") for k, name in enumerate(BASE)], F.sha2(F.array_join(F.transform(base, said), ","), 256).alias("base_sha256"), F.array_join(F.transform("spans", said), ",").alias("spans"))
