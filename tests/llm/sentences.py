"""Made-up sentences in nine languages, of parts that combine freely, and misreadings to garble them with."""

PARTS = {
    "de": (["Der Schüler", "Die Bäckerin", "Unser Müller", "Der böse König", "Eine schöne Gräfin", "Der fröhliche Gärtner", "Das Mädchen", "Mein Großvater"], ["öffnet heute die Tür", "hört die Vögel über der Straße", "genießt süße Brötchen", "fährt früh nach Köln", "läuft durch die Wälder", "verkauft Äpfel und Nüsse", "überquert die große Brücke", "zählt die Häuser am Fluß"]),
    "fr": (["L’élève", "La boulangère", "Notre forêt", "Le garçon", "Un vieux château", "Ma chère sœur", "Le maître d’hôtel", "Cet été"], ["répète la leçon à voix haute", "découvre un île déserte", "reçoit une lettre étrange", "préfère le thé glacé", "s’arrête près de l’église", "a changé très tôt", "traverse le fleuve gelé", "décide où dîner après le théâtre"]),
    "es": (["El niño", "La señora", "Nuestro pequeño jardín", "El médico", "Una canción", "El león", "La mañana", "El último tren"], ["llegó después de la lección", "está aquí también", "volverá mañana por la tarde", "perdió el corazón en Málaga", "cruzó el océano Atlántico", "comió piña y limón", "cantó más allá del río", "¿dónde durmió anteayer?"]),
    "pt": (["O avô", "A irmã", "Nossa estação", "O coração", "Uma canção", "O pão", "A manhã", "O capitão"], ["não está aqui à tarde", "voltará amanhã de avião", "começou a lição às três", "caiu no chão da cozinha", "é também útil", "trouxe maçãs e limões", "atravessou o rio até São João", "vê além das montanhas"]),
    "pl": (["Żółta łódź", "Mój dziadek", "Młoda księżniczka", "Wąska ścieżka", "Stary młyn", "Pięć gęsi", "Mała wróżka", "Ten źrebak"], ["płynie szybko ku wyspie", "śpi już długo", "zgubiła się wśród wzgórz", "prowadzi przez gęsty las", "potrzebuje świeżej mąki", "ucieka z łąki", "znalazła srebrną łyżkę", "skończył się późną jesienią"]),
    "ru": (["Ученик", "Старая мельница", "Наша соседка", "Весёлый садовник", "Ранний поезд", "Моя сестра", "Широкая река", "Белый медведь"], ["открывает дверь и слышит птиц", "стоит на берегу озера", "продаёт яблоки и груши", "поливает цветы вечером", "прибыл в город утром", "читает длинное письмо", "течёт между холмами", "спит под толстым льдом"]),
    "vi": (["Học sinh", "Người làm vườn", "Chị gái tôi", "Con mèo đen", "Ông nội", "Chuyến tàu sớm", "Dòng sông rộng", "Cô giáo"], ["mở cửa và nghe tiếng chim", "tưới hoa vào buổi tối", "đọc một bức thư dài", "ngủ dưới gốc cây", "kể chuyện ngày xưa", "đến thành phố lúc sáng sớm", "chảy giữa những ngọn đồi", "viết bảng bằng phấn trắng"]),
    "ja": (["生徒は", "古い水車は", "私の姉は", "庭師は", "早い列車は", "広い川は", "白い猫は", "先生は"], ["窓を開けて鳥の声を聞く。", "湖のそばに立っている。", "長い手紙を読んだ。", "夕方に花へ水をやる。", "朝早く町に着いた。", "丘の間を流れている。", "木の下で眠っている。", "黒板に字を書いた。"]),
    "en": (["The student’s café", "Grandfather — a naïve man —", "“My sister”", "The old mill’s owner", "Our coöperative", "An early résumé", "The façade", "That ‘quiet’ gardener"], ["didn’t open before 5 °C", "costs €80 – or £70", "can’t sell apples…", "waters 12 m² of roses", "won’t arrive “on time”", "reads a long letter — twice", "isn’t ± exact", "sleeps under ½ a tree"]),
}
MISREADINGS = ("cp1252", "latin-1", "cp437", "mac_roman", "cp1251", "cp850", "koi8-r", "cp866", "cp1250", "iso8859-2", "cp1254", "cp1257")


def sentences() -> list[tuple[str, str]]:
    """(language, text) of every combination."""
    return [(lang, f"{a} {b}".replace("は ", "は") + ("" if lang == "ja" else ".")) for lang, (heads, tails) in PARTS.items() for a in heads for b in tails]


def garbled(text: str, encoding: str, depth: int = 1) -> str:
    """UTF-8 read in another encoding, as often as depth says; bytes it leaves undefined stand for themselves."""
    for _ in range(depth):
        text = "".join(bytes([x]).decode(encoding, "ignore") or chr(x) for x in text.encode())
    return text
