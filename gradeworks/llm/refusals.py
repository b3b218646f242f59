"""A classifier that tells responses that decline from responses that answer.

Naive Bayes over which word n-grams a response has, names and values as classes; scripts without
spaces give character n-grams.  It is fitted on labelled responses: examples in twenty languages,
responses of the input that were marked correct, and wrong ones that a plain form of declining
labels.  That form is one more feature of a response and decides nothing by itself.
"""

from __future__ import annotations

import math
from collections import Counter

#: Labelled examples of how responses decline, by language.
EXAMPLES = {
    "en": ("I cannot answer this question.", "I'm sorry, but I can't help with that.", "I am unable to read the image.", "As an AI model, I must decline to respond.", "Unfortunately, I do not have access to this document.", "I would rather not say.", "It is not possible for me to answer."),
    "de": ("Ich kann diese Frage nicht beantworten.", "Leider kann ich das Bild nicht lesen.", "Es tut mir leid, aber ich darf dazu keine Auskunft geben.", "Ich bin nicht in der Lage, das Dokument zu lesen.", "Dabei kann ich nicht helfen."),
    "fr": ("Je ne peux pas répondre à cette question.", "Désolé, je ne suis pas en mesure de lire cette image.", "Je regrette, mais je dois refuser de répondre.", "Malheureusement, je n'ai pas accès au document.", "Je préfère ne pas répondre."),
    "es": ("No puedo responder a esta pregunta.", "Lo siento, pero no puedo leer la imagen.", "Lamentablemente, no tengo acceso al documento.", "Debo negarme a responder.", "Prefiero no contestar."),
    "it": ("Non posso rispondere a questa domanda.", "Mi dispiace, ma non riesco a leggere l'immagine.", "Purtroppo non ho accesso al documento."),
    "pt": ("Não posso responder a esta pergunta.", "Desculpe, mas não consigo ler a imagem.", "Infelizmente, não tenho acesso ao documento."),
    "nl": ("Ik kan deze vraag niet beantwoorden.", "Sorry, maar ik kan de afbeelding niet lezen.", "Helaas heb ik geen toegang tot het document."),
    "sv": ("Jag kan inte svara på den frågan.", "Tyvärr kan jag inte läsa bilden.", "Jag har inte tillgång till dokumentet."),
    "pl": ("Nie mogę odpowiedzieć na to pytanie.", "Przepraszam, ale nie mogę odczytać obrazu.", "Niestety nie mam dostępu do dokumentu."),
    "cs": ("Na tuto otázku nemohu odpovědět.", "Bohužel nemohu přečíst obrázek.", "Nemám přístup k dokumentu."),
    "tr": ("Bu soruyu yanıtlayamam.", "Üzgünüm, görseli okuyamıyorum.", "Maalesef belgeye erişimim yok."),
    "ru": ("Я не могу ответить на этот вопрос.", "К сожалению, я не могу прочитать изображение.", "Извините, но у меня нет доступа к документу."),
    "uk": ("Я не можу відповісти на це запитання.", "На жаль, я не можу прочитати зображення.", "Вибачте, у мене немає доступу до документа."),
    "el": ("Δεν μπορώ να απαντήσω σε αυτή την ερώτηση.", "Λυπάμαι, αλλά δεν μπορώ να διαβάσω την εικόνα."),
    "vi": ("Tôi không thể trả lời câu hỏi này.", "Xin lỗi, tôi không thể đọc hình ảnh."),
    "ar": ("لا أستطيع الإجابة عن هذا السؤال.", "آسف، لا يمكنني قراءة الصورة."),
    "hi": ("मैं इस प्रश्न का उत्तर नहीं दे सकता।", "क्षमा करें, मैं चित्र नहीं पढ़ सकता।"),
    "zh": ("我无法回答这个问题。", "抱歉，我不能读取这张图片。", "很遗憾，我没有权限访问该文件。"),
    "ja": ("この質問にはお答えできません。", "申し訳ありませんが、画像を読み取ることができません。"),
    "ko": ("이 질문에 답변할 수 없습니다.", "죄송하지만 이미지를 읽을 수 없습니다."),
}
#: Labelled examples of responses that answer, by language, with words that refusals share.
ANSWERS = {
    "en": ("The answer is not in the table but on the first page.", "No other number is given in this document.", "I can see that the total is 5."),
    "de": ("Die Antwort steht nicht in der Tabelle.", "Ich kann sehen, dass der Wert 5 ist.", "Im Dokument steht keine andere Zahl."),
    "fr": ("La réponse n'est pas dans le tableau.", "Je peux voir que la valeur est 5.", "Il n'y a pas d'autre nombre dans le document."),
    "es": ("La respuesta no está en la tabla.", "Puedo ver que el valor es 5.", "No hay otro número en el documento."),
    "it": ("La risposta non è nella tabella.", "Non c'è altro numero nel documento.", "Il valore su questa pagina è 5."),
    "pt": ("A resposta não está na tabela.", "Não há outro número no documento além de 5.", "O valor nesta página é 5."),
    "nl": ("Het antwoord staat niet in de tabel.", "In het document staat geen ander getal.", "De waarde op deze pagina is 5."),
    "sv": ("Svaret står inte i tabellen.", "Jag kan se att värdet är 5.", "Det finns inget annat tal i dokumentet."),
    "pl": ("Odpowiedzi nie ma w tabeli.", "W dokumencie nie ma innej liczby.", "Wartość na tej stronie to 5."),
    "cs": ("Odpověď není v tabulce.", "V dokumentu není jiné číslo.", "Hodnota na této stránce je 5."),
    "tr": ("Cevap tabloda değil.", "Belgede başka sayı yok.", "Bu sayfadaki değer 5."),
    "ru": ("Ответа нет в таблице.", "В документе нет другого числа.", "Значение на этой странице 5."),
    "uk": ("Відповіді немає в таблиці.", "У документі немає іншого числа.", "Значення на цій сторінці 5."),
    "el": ("Η απάντηση δεν είναι στον πίνακα.", "Η τιμή σε αυτή τη σελίδα είναι 5.", "Στο έγγραφο δεν υπάρχει άλλος αριθμός."),
    "vi": ("Câu trả lời không có trong bảng.", "Giá trị trên trang này là 5."),
    "ar": ("الإجابة ليست في الجدول.", "القيمة في هذه الصفحة هي 5."),
    "hi": ("उत्तर तालिका में नहीं है।", "इस पृष्ठ पर मान 5 है।"),
    "zh": ("答案不在表格中。", "这张图片上的数字是5。", "文件的最后一行写着这个答案。"),
    "ja": ("答えは表にありません。", "このページに書かれている値は5です。", "最後の行に答えがあります。"),
    "ko": ("답은 표에 없습니다.", "이 페이지의 값은 5입니다.", "마지막 줄에 답이 적혀 있습니다."),
}
#: What an example counts for beside the responses of the input.
EXAMPLE_WEIGHT = 3
FORM = "\x1e"


def features(tokens: list[str], shaped: bool, most: int = 3) -> set[str]:
    """Which n-grams of tokens a response has, and whether it has the plain form of declining."""
    seen = [t if t[0] == "<" else t.lower() for t in tokens]
    out = {"\x1f".join(seen[i : i + n]) for n in range(1, most + 1) for i in range(len(seen) - n + 1)}
    for t in seen:
        if max(t) > "\u0dff":
            out.update(t[i : i + n] for n in (2, 3) for i in range(len(t) - n + 1))
    if shaped:
        out.add(FORM)
    return out


class RefusalModel:
    """Log-odds of features; a response declines if their sum, over the root of their number, passes a bound."""

    def __init__(self, refused: Counter, answered: Counter, n_refused: int, n_answered: int, bound: float = 7.0) -> None:
        self.bound = bound
        self.weights = {g: math.log((refused[g] + 0.5) / (n_refused + 1)) - math.log((answered[g] + 0.5) / (n_answered + 1)) for g in {*refused, *answered} if refused[g] + answered[g] > 1}

    @classmethod
    def of(cls, refused: Counter, answered: Counter, n_refused: int, n_answered: int, examples: tuple[list[set[str]], list[set[str]]], **options) -> RefusalModel:
        """The model of counted responses and of labelled examples: refusals and answers."""
        counts = [Counter(refused), Counter(answered)]
        for count, listed in zip(counts, examples, strict=True):
            for f in listed:
                count.update(dict.fromkeys(f, EXAMPLE_WEIGHT))
        return cls(*counts, n_refused + EXAMPLE_WEIGHT * len(examples[0]), n_answered + EXAMPLE_WEIGHT * len(examples[1]), **options)

    def score(self, found: set[str]) -> float:
        """How much speaks for a refusal."""
        get = self.weights.get
        return sum(get(g, 0.0) for g in found) / math.sqrt(max(3, len(found)))

    def declines(self, found: set[str]) -> bool:
        """Whether a response with these features declines."""
        return self.score(found) > self.bound
