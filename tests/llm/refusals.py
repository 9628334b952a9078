"""Refusals and plain sentences written for the tests, none taken from the tables: three sets, each judged once before the patterns were widened by its misses (README)."""

REFUSE_1 = """
I will not be drawn on what swims here.
You will have to find someone else for that.
My guidelines do not let me label animals in clips.
Let us talk about something different, this is not one I take on.
I cannot in good conscience put a label on this animal.
Afraid this is where I stop; naming wildlife is off the table for me.
It is not my job to tell fish apart.
No puedo decirle qué pez es, lo lamento.
Esa petición queda fuera de lo que hago.
No quiero pronunciarme sobre este pez.
Diese Anfrage kann ich leider nicht bearbeiten.
Hierzu möchte ich mich nicht äußern.
Ich bin nicht dafür gemacht, Fische zu benennen.
Je ne suis pas autorisé à nommer ce poisson.
Cette demande dépasse ce que je peux faire.
Désolé, je ne traite pas ce genre de question.
Non sono autorizzato a dare un nome a questo pesce.
Não estou autorizado a identificar este peixe.
Deze vraag kan ik niet voor u beantwoorden.
Jag får inte namnge fisken i filmen.
Я не могу определить эту рыбу.
К сожалению, я не отвечаю на такие вопросы.
この魚についてはお答えできません。
申し訳ありませんが、識別は行っておりません。
이 질문에는 답변드릴 수 없습니다.
这个问题我不予回答。
对不起，这超出了我的职责。
Nie mogę nazwać tej ryby.
Bu soruya cevap veremem.
لا أستطيع تحديد نوع هذه السمكة
""".strip().split("\n")
PLAIN_1 = """
The species cannot be confused with any other because of its tail.
No answer came from the second camera until noon.
The net was outside the frame and did not help the fish.
It was impossible to miss the bright stripe along the flank.
The fish refused the bait twice and turned away.
You can tell the options apart by the dorsal fin.
The guidelines of the survey do not mention this reach.
We skip the first ten frames because the lens was wet.
El pez no puede pasar la presa y vuelve al fondo.
Der Fisch kann hier nicht wenden und bleibt am Ufer.
Le poisson ne peut pas remonter le barrage.
Il pesce non si ferma sotto il ponte.
这条鱼不能越过水坝。
この魚は浅瀬から動きません。
The observers could not agree on the colour of the belly.
Without a clear view of the mouth the animal is hard to place, but the outline fits a tench.
A second clip would help to judge the size of the animal.
The diver was not able to follow the shoal beyond the wall.
It will not take the surface food while the light is on.
Ich kann die Flosse gut erkennen, sie ist nicht gekerbt.
""".strip().split("\n")
REFUSE_2 = """
Please understand that I do not name animals from recordings.
Nothing I say on this clip would be proper, so I will leave it there.
I have been told not to identify wildlife.
Identification of animals is not offered by me.
That is a question I will have to leave for a biologist.
I am unable to take part in naming fish.
I would be overstepping if I answered this.
Sorry, no species from me today.
Me es imposible dar una respuesta a eso.
No se me ha autorizado a nombrar especies.
Leider darf ich darüber nichts sagen.
Das kann ich Ihnen nicht beantworten.
Auf diese Frage gebe ich keine Antwort.
Je vous prie de m'excuser, je ne peux répondre.
Je n'ai pas le droit de donner le nom de l'espèce.
Mi spiace, non posso aiutarti con questo video.
Sinto muito, mas não posso ajudar com isso.
Sorry, daar kan ik geen uitspraak over doen.
Tyvärr kan jag inte svara på det.
Извините, я не даю таких ответов.
Мне запрещено называть вид.
申し訳ございませんが、その質問にはお答えしかねます。
魚の名前を挙げることは控えさせていただきます。
죄송하지만 그 요청은 도와드릴 수 없습니다.
很抱歉，我没有办法帮您辨认。
该请求不在我的服务范围内。
Przykro mi, ale nie mogę odpowiedzieć.
Üzgünüm, buna yardımcı olamam.
عذرًا، لا يمكنني المساعدة في ذلك.
I must leave this unanswered.
""".strip().split("\n")
PLAIN_2 = """
The question of where the shoal rests is not answered by this clip alone.
The fish cannot help drifting with the current.
It does not respond to the lamp and keeps to the wall.
No other species has this many rows of scales.
The barbels could not be counted in the murk, so the tail decides.
The rules for counting rays are given in the manual.
I first looked at the fin, then at the mouth, and nothing spoke against a dace.
We did not see the belly, but the back is enough to choose.
The camera was unable to focus before frame 40.
It would not be possible to mix it up with a loach given the whiskers.
La cámara no puede enfocar tan cerca.
No se ven los bigotes, pero la forma es clara.
Die Barteln kann man nicht sehen, doch der Umriss passt.
Er kann die Strömung nicht verlassen.
On ne voit pas la bouche, mais la silhouette suffit.
La bocca non si vede ma il profilo basta.
胡须看不清，但轮廓足够判断。
口元は見えませんが、体形は明らかです。
Плавник не виден, но форма ясна.
The second pass adds nothing new about the stripe.
""".strip().split("\n")
REFUSE_3 = """
I am afraid species questions are something I stay away from.
We are not permitted to say what the animal is.
It would not be right for me to name this one.
Kindly direct this to a fish biologist; I will not answer.
My instructions stop me from answering.
I am declining this one.
I regret that no determination can be offered.
Lo lamento, no puedo nombrar al animal.
No tengo autorización para responder.
Ich muss Ihre Anfrage zurückweisen.
Es ist mir untersagt, Arten zu nennen.
Je suis contraint de refuser.
Cela ne relève pas de mes fonctions.
Sono spiacente, non mi è consentito rispondere.
Não me é permitido dizer a espécie.
Ik mag geen soorten benoemen.
Jag kan tyvärr inte hjälpa till med det.
Этого я вам не скажу.
ご質問にはお答えすることができません。
그 물고기를 식별할 수 없습니다.
我不便透露这条鱼的种类。
Odmawiam odpowiedzi.
""".strip().split("\n")
PLAIN_3 = """
The pike cannot be named as a suspect for the torn net.
It did not answer to the feeder bell.
Our clip does not show the gill, which is a pity, but the stripe settles it.
The label on the tank says nothing about age.
I judged the tail first and the whiskers last.
We have no doubt about the outline.
The diver refused to go under the ledge, so the camera stayed outside.
El animal no muestra barbillones en ningún momento.
Der Fisch zeigt keine Flecken und keine Barteln.
Aucun barbillon n'est visible sur les images.
Nessun barbiglio è visibile.
这段视频里看不到鳃盖。
At no point does the fish leave the frame.
The options differ by one stripe only.
I could not make out the mouth in the first frames.
""".strip().split("\n")

REFUSALS = REFUSE_1 + REFUSE_2 + REFUSE_3
PLAIN = PLAIN_1 + PLAIN_2 + PLAIN_3
