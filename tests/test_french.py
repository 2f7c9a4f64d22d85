import pytest

from skein.functions import french

STEMS = {  # published examples of these rules
    "continu": "continu", "continua": "continu", "continuait": "continu", "continuant": "continu", "continuation": "continu",
    "continue": "continu", "continuel": "continuel", "continuelle": "continuel", "continuellement": "continuel", "continuer": "continu",
    "continuité": "continu", "continuons": "continuon", "contraction": "contract", "contourna": "contourn", "contraignit": "contraign",
    "main": "main", "mains": "main", "maintenaient": "mainten", "maintenant": "mainten", "maintenir": "mainten", "maintenue": "maintenu",
    "maire": "mair", "mairie": "mair", "maison": "maison", "maisons": "maison", "maître": "maîtr", "maîtresse": "maîtress",
    "majesté": "majest", "majestueuse": "majestu", "majestueusement": "majestu", "majestueux": "majestu", "malade": "malad", "maladie": "malad",
}
RULES = {  # a word for each rule, its stem worked out by hand from the regions
    "actrices": "actric", "modificateur": "modif", "communication": "commun", "géologie": "géolog", "solutions": "solut", "fréquence": "fréquenc",
    "activement": "activ", "heureusement": "heureux", "aimablement": "aimabl", "premièrement": "premi", "stabilité": "stabl", "électricité": "électr",
    "négatifs": "négat", "bateaux": "bateau", "chevaux": "cheval", "établissement": "établ", "constamment": "const", "évidemment": "évident",
    "finissons": "fin", "chantions": "chantion", "chanterait": "chant", "mangea": "mang", "nation": "nation", "première": "premi",
    "garçons": "garçon", "quelle": "quel", "payer": "pai", "": "", "a": "a", "été": "été", "42": "42",
}


@pytest.mark.parametrize("word, want", [*STEMS.items(), *RULES.items()])
def test_stems(word, want):
    assert french.stem(word) == want


def test_regions():
    assert french._regions("aimer")[0] == 3 and french._regions("adorer")[0] == 3 and french._regions("voler")[0] == 2 and french._regions("tapis")[0] == 3
    assert french._regions("fameusement")[1:] == (3, 6)
    assert [french._marked(w) for w in ("jouer", "ennuie", "yeux", "quand", "croyiez")] == ["joUer", "ennuIe", "Yeux", "qUand", "croYiez"]
