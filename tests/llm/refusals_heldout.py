"""Refusals and legal answers written for measuring, not used to fill the dictionaries."""

REFUSALS = """
Увы, тут я вам не помощник: ответить не смогу.
На подобные вопросы я не отвечаю.
Такие темы мне обсуждать не разрешено.
Я не нашел в источниках ничего, что помогло бы с ответом.
Мне не хватает данных, чтобы ответить на этот вопрос.
Об этом в предоставленных документах ничего не сказано.
Контекст не содержит информации по вашему вопросу.
К сожалению, ответа на ваш вопрос в материалах нет.
Не располагаю сведениями на этот счет.
Я не обладаю нужной информацией. Обратитесь в инспекцию.
Этот вопрос выходит за пределы моих возможностей.
Подсказать по этой теме ничего не могу.
Прокомментировать это не получится.
В приведенных фрагментах ответ отсутствует.
В базе знаний нет материалов по данной теме.
Простите, но консультировать по таким делам я не вправе.
Я всего лишь ассистент и не могу дать юридическое заключение.
Мне неизвестно, как решается такой вопрос.
Не знаю, что вам ответить.
Я воздержусь от комментариев.
Предпочту промолчать.
Боюсь, помочь не сумею.
Вопрос не относится к нашей тематике.
Это вне моей компетенции.
Рассмотреть такой запрос я не имею права.
Источники умалчивают об этом, поэтому ответа дать нельзя.
По найденным отрывкам сделать вывод по вопросу невозможно.
Ничего полезного по вашему запросу не нашлось.
Сведений для ответа не хватает.
Данных слишком мало, чтобы ответить определенно.
Недостаточно контекста.
Информации нет.
Отказываюсь отвечать.
Я вынужден отказать вам в ответе.
Затрудняюсь ответить.
Здравствуйте! Затрудняемся что-либо посоветовать.
Не возьмусь судить об этом.
Без дополнительных сведений ответить на вопрос нельзя.
Пояснить это я не готов.
Давать оценку таким ситуациям я не буду.
Мы не консультируем по этим вопросам.
Наш сервис не отвечает на вопросы такого рода.
Модель не может ответить на данный запрос.
Я не специалист в этой теме и ничего не скажу.
Мне нечего добавить.
Сказать что-либо определенное я не могу.
По этой теме мне нечего вам предложить.
К сожалению, поиск ничего не дал.
Контекст пуст.
Выдержки слишком кратки, чтобы ответить на вопрос.
Документы не затрагивают эту тему.
В текстах не упоминается то, о чем вы спрашиваете, ответа нет.
Мой ответ: не знаю.
Я не в состоянии ответить на поставленный вопрос.
Найти ответ не удалось.
Ответ найти не удалось, попробуйте переформулировать запрос.
Увы, не могу.
Помочь вам, к сожалению, не могу. Обратитесь к юристу.
Такой информации у нас нет.
Разъяснений по этому вопросу у меня нет.
Материалов по вопросу не обнаружено.
Не хотелось бы рассуждать на эту тему.
Мне запрещено давать налоговые консультации.
Я не уполномочен отвечать на такие обращения.
Эту тему мы не обсуждаем.
Определить это по имеющимся данным я не могу, вопрос остается без ответа.
Из переданного текста ответить на вопрос не получается.
Ни в одном из источников нет ответа.
Имеющиеся материалы не позволяют ответить на вопрос.
Представленные источники не дают ответа.
Я не смогу разобрать ваш случай и что-то посоветовать.
Прошу прощения, но это не ко мне вопрос, ответить не могу.
К сожалению, я не нашел ответа.
Мои знания не охватывают этот вопрос.
В моих данных об этом сведений нет.
У меня нет доступа к информации, чтобы ответить.
Судить о вашей ситуации не берусь.
Сообщить вам что-либо по данному поводу не могу.
Не имею возможности дать совет.
Дать рекомендацию по этому вопросу затруднительно.
Высказать мнение по теме я не решусь.
Предоставленного контекста недостаточно для ответа.
По имеющимся выдержкам ответ дать невозможно.
Подходящих сведений не найдено.
Релевантных документов по запросу нет.
Извините, этот запрос я обработать не могу, ответа не будет.
Я не юрист и консультаций не даю.
Ваш вопрос останется без ответа.
Ничем помочь не могу.
Не обладаем сведениями, необходимыми для ответа.
Про это мне ничего не известно.
Рекомендаций на этот счет дать не могу.
Тут я бессилен, ответа у меня нет.
Этого я вам не скажу.
Отвечать на это не стану.
Я бы не хотел комментировать данную тему.
В документах ни слова об этом вопросе.
Мне нельзя обсуждать подобные вещи.
Справочная служба таких консультаций не дает.
Пожалуйста, обратитесь к специалисту: сам я ответить не вправе.
I'm afraid I can't help with that.
I do not have enough information to answer this question.
The provided context does not mention this topic.
The sources say nothing about it.
Sorry, that is beyond my expertise.
I don't know the answer.
I have no information about that.
We are not able to advise on this matter.
I would rather not comment on this subject.
This assistant does not provide legal advice.
There is not enough context to answer.
The documents supplied are silent on this question.
No relevant information was found.
I could not find anything useful in the materials.
I won't discuss this.
I must decline to answer.
It is not possible to answer from the given excerpts.
Answering this is outside the scope of the service.
I lack the knowledge to respond.
The passages fail to address the question.
I am not qualified to give an opinion here.
Unfortunately, I cannot provide guidance on that.
My sources do not cover this, so I have no answer.
I regret that I cannot say more on the subject.
Nothing in the retrieved texts answers the question.
The material is too thin to draw a conclusion.
That question is out of scope.
I refuse to answer this request.
No comment.
Hello! I am unable to assist with this request. Please contact a lawyer.
I have nothing to say on that.
I'm not in a position to judge.
We do not respond to questions of this kind.
I can't tell from the excerpts given.
Insufficient information.
The context is empty.
I was not able to find an answer.
I am not allowed to discuss such matters.
It is impossible to say from the available sources.
I will have to pass on this question.
Apologies, but no answer is available.
The search returned nothing relevant.
I have no idea.
As a language model, I do not give tax advice.
This topic is off limits for me.
The text does not contain an answer to your question.
I cannot determine this from the provided documents.
Your question cannot be answered with the given material.
We have no data on this topic.
I don't have access to that information.
I prefer not to answer.
Please rephrase; I cannot understand the question.
Regrettably, there is nothing in the passages about this.
None of the sources answers the question.
The excerpts are unrelated to the question.
I do not feel able to advise you on this.
I can offer no opinion on that.
I couldn't locate any information on the subject.
There is no answer in the documents.
I am sorry, I do not know.
Этого в моей базе нет, поэтому ответить не могу.
Боюсь, ответа у меня для вас нет.
Не уверен, что вправе отвечать на это, поэтому воздержусь.
Ни одного подходящего источника я не нашел.
К сожалению, по этому запросу ничего не найдено.
Документы, которые мне дали, об этом молчат.
Мне трудно ответить на ваш вопрос.
Я не обсуждаю такие темы.
Я не даю советов по налогам.
Вопрос сложный, и ответить на него я не сумею.
Консультации такого рода мы не оказываем.
Комментариев не будет.
Не могу ничего посоветовать.
Я не понимаю вопроса и не могу на него ответить.
Для ответа не хватает исходных данных.
В источниках нет прямого ответа.
Нужных сведений в контексте нет.
Мне об этом не известно.
Ответ на этот вопрос мне неизвестен.
Поищите ответ в другом месте: я им не располагаю.
I am unable to comment.
I can't find an answer in the sources.
I don't think I can answer that.
We cannot assist with this topic.
My knowledge does not extend to this question.
The given text offers no answer.
I have not been given enough information to respond.
The documents do not help with this question.
This is not something I can discuss.
I am afraid I have no information.
The assistant cannot answer questions like this.
I would prefer not to say.
I know too little about the subject to answer.
There is nothing in the sources I could rely on to answer.
I do not wish to discuss this topic.
Sorry, I can't say.
I am not the right one to ask about this matter.
The question goes beyond what I am able to answer.
The context provides no details about this.
I have insufficient data to reply.
""".strip().splitlines()

ANSWERS = """
Вычет нельзя заявить повторно.
Без подтверждающих документов вычет не предоставляется.
Налогоплательщик не может применять льготу дважды.
Организация не вправе учитывать эти расходы.
Штраф не начисляется, если ошибка исправлена до проверки.
Инспекция не вправе истребовать документы вне проверки.
Сумма налога не может превышать сумму дохода.
Нет, такие расходы не учитываются.
Нет, подавать уведомление не нужно.
Отсутствие подписи делает документ недействительным.
Если в счете нет сведений о покупателе, вычет не применяется.
Документы не содержат подписи руководителя, поэтому расходы не признаются.
Налоговая база не уменьшается на сумму аванса.
Возврат налога невозможен после трех лет.
Перенос убытка на прошлые годы запрещен.
Применять ставку 0 процентов без договора нельзя.
Уплата налога за третье лицо не запрещена.
Срок подачи не продлевается.
Декларация не подается, если дохода не было.
Недостаточно одного акта: нужен и счет-фактура.
Плательщик обязан ответить на требование в течение пяти дней.
На требование инспекции нужно ответить в срок.
Отказ в вычете можно обжаловать в вышестоящий орган.
Отказаться от льготы можно по заявлению.
Инспекция отказывает в возврате, если пропущен срок.
Банк не может раскрывать сведения о счетах третьим лицам.
Агент не удерживает налог с выплат до 4000 рублей.
Предприниматель не платит налог на имущество.
Вычет не положен при сделке между родственниками.
Уменьшить налог на эти взносы нельзя.
Проверка не может длиться более двух месяцев.
Повторная проверка за тот же период не допускается.
Такой договор не облагается пошлиной.
Расходы на питание не принимаются к учету.
Документ без даты не подтверждает расходы.
Нельзя учесть расходы, не связанные с доходом.
Запись в книге не заменяет первичный документ.
Пени не начисляются за период приостановки.
Суд не принял доводы налогоплательщика.
Заявление без подписи не рассматривается.
Жалоба не рассматривается, если подана с пропуском срока.
Работник не обязан сообщать о своих доходах работодателю.
Материальная помощь не включается в базу.
Право на вычет не переходит к наследникам.
Сведения об участниках не подлежат разглашению.
Должник не может зачесть требование в одностороннем порядке.
Документы за пределами срока хранения не представляются.
Нет необходимости подавать корректировку.
Нет оснований для начисления пеней.
Нет, регистрация не требуется.
Доход вне компетенции налогового органа не образуется.
Аванс не признается доходом до отгрузки.
Льгота не применяется к товарам для перепродажи.
Вычет предоставляется один раз.
Налог платится не позднее 1 декабря.
Не позднее 25 апреля.
Нулевую отчетность сдавать обязательно.
Неуплата налога влечет штраф 20 процентов.
Ошибка в реквизитах не мешает зачету.
Расчет не представляется при отсутствии работников.
При отсутствии данных доход определяют расчетным путем.
Если сведений недостаточно, инспекция применяет расчетный метод.
Если документы утрачены, их восстанавливают.
Учет ведется без применения кассы.
Без регистрации деятельность вести нельзя.
Отсрочка не предоставляется при наличии дела о банкротстве.
Решение об отказе выносится в течение десяти дней.
Ответ на запрос дает инспекция в течение 30 дней.
За разъяснением нужно обратиться в Минфин.
Консультации инспекции бесплатны.
Да, вправе, но только один раз в год.
Да, при условии, что счет оплачен.
Вычет по процентам ограничен тремя миллионами рублей.
Сделка не признается контролируемой.
Взносы не уплачиваются за месяцы отпуска по уходу.
Нерезидент не имеет права на вычет.
Срок давности не может быть восстановлен.
Акт не содержит суммы, поэтому он исправляется.
Представитель без доверенности не допускается.
Требование без даты не исполняется.
Компания не может менять метод в течение года.
Удержать налог невозможно, если доход выплачен в натуре.
Невозможно зачесть переплату старше трех лет.
Имущество, не введенное в эксплуатацию, не амортизируется.
Запрещено вычитать налог по чекам без выделенной суммы.
Ограничение не касается малых предприятий.
Такие выплаты не относятся к доходам.
Этот порядок не распространяется на подрядчиков.
Налоговый орган не начисляет пени на авансы.
Патент не действует в другом регионе.
Счет можно не выставлять, если стороны согласились.
Уведомление о переходе не подается задним числом.
Продавец не несет ответственности за покупателя.
Нельзя совмещать два режима по одному виду деятельности.
Участник не отвечает по долгам общества.
Руководитель не отвечает по долгам после закрытия дела.
Займ не является доходом.
Возврат не производится наличными.
Ставка не меняется в течение периода.
Подтверждать расходы не требуется.
The loss cannot be carried back.
No deduction is allowed without an invoice.
A taxpayer may not claim the relief twice.
The company cannot deduct entertainment expenses.
No, the return is not required.
No penalty applies when the error is corrected in time.
The agent is not entitled to defer the payment.
Interest is not charged during suspension.
The refund is not possible after three years.
A document without a signature does not confirm the expense.
The inspectorate cannot request papers outside an audit.
Without registration the activity is not permitted.
If the information is missing, the income is estimated.
If no documents were kept, the expense is refused.
The authority refuses the refund when the term has passed.
A refusal can be appealed within one month.
The relief does not apply to resold goods.
Non-residents are not entitled to the deduction.
The bank cannot disclose account data to third parties.
The buyer does not have to answer for the seller.
The taxpayer must answer the demand within five days.
The rate does not change during the period.
There is no need to file a correction.
There is no tax on this payment.
There is no limit for such expenses.
The deadline is not extended.
No tax is withheld from payments below the threshold.
Advances are not income before shipment.
The contract is outside the scope of value added tax.
Such services are beyond the scope of the exemption.
The declaration does not need a signature.
It is not permitted to combine two regimes.
A second audit of the same period is not allowed.
The patent is not valid in another region.
An invoice without a date cannot support the deduction.
Losses older than ten years cannot be used.
The director is not liable after the case is closed.
A loan is not income.
Employees do not report other income to the employer.
The payer cannot change the method within a year.
The statement must be refused if filed late.
The notice is not accepted without an annex.
Insufficient documents lead to denial of the deduction.
Failure to answer the notice leads to a fine.
The claim is declined when the form is wrong.
The exemption is unavailable to importers.
Costs unrelated to income are not deductible.
The act lacks the amount, so it is corrected.
Payment in kind makes withholding impossible.
Only residents may use the simplified regime.
No, advance payments are not refunded.
Yes, but not more than once a year.
It depends on the date of the contract.
The tax is due by 25 April.
Supporting documents are not required for small sums.
The heirs cannot take over the deduction.
The fine is not imposed twice.
Goods in transit are not taxed.
Donations between relatives are not taxed.
The representative cannot act without a power of attorney.
Продавец обязан выдать чек без напоминания.
Нет, льгота не сохраняется.
Нельзя, так как договор расторгнут.
Не облагается.
Не учитываются.
Плательщик не указал код, поэтому декларация уточняется.
Срок не пропущен.
Инспекция молчит больше месяца, поэтому жалоба обоснована.
Данные реестра не являются тайной.
Сведения подаются не позднее пятого числа.
Материалы проверки не передаются третьим лицам.
Документы на товар не нужны.
Источник выплаты не удерживает налог с подарков.
Текст договора не влияет на ставку.
Ответ контрагента не требуется.
Вопрос о штрафе решает суд.
Работодатель не отвечает за ошибки работника.
Контекст закупки не важен: ставка одна.
Справка не заменяет декларацию.
Льгота не дает права на возврат.
The invoice is missing, so the deduction is denied.
No documents are needed for small sums.
No answer from the buyer is required.
The source of payment does not withhold tax on gifts.
The register data are not secret.
The answer of the inspectorate is not binding.
The information must be filed by the fifth day.
The court does not accept late evidence.
The text of the contract does not affect the rate.
Nothing is due before shipment.
The audit materials are not passed to third parties.
The seller cannot refuse a receipt.
There is nothing to pay for this period.
Failure to provide information leads to a fine.
The certificate does not replace the return.
The bank may not delay the payment.
The question of the fine is decided by the court.
It is not taxed.
It cannot be deducted.
The employer is not liable for the error of an employee.
""".strip().splitlines()
