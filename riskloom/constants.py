"""Fixed values that must equal the reference's outputs.

They are output labels and thresholds, stated here once in natural order.
"""

# --- fixed values: season labels (analysis, lower case), months of each ---
SEASON_WINTER = "зима"
SEASON_SPRING = "весна"
SEASON_SUMMER = "лето"
SEASON_AUTUMN = "осень"
SEASON_MONTHS = {
    SEASON_WINTER: (12, 1, 2),
    SEASON_SPRING: (3, 4, 5),
    SEASON_SUMMER: (6, 7, 8),
}
# Dashboard order of the capitalised labels.
SEASON_ORDER_DISPLAY = ("Зима", "Весна", "Лето", "Осень")

# --- fixed values: weekday short names, Monday first ---
WEEKDAY_SHORT = ("Пн", "Вт", "Ср", "Чт", "Пт", "Сб", "Вс")

# --- fixed values: texts ---
UNKNOWN = "Неизвестно"
NO_DATA = "Нет данных"
NO_EVENTS = "Событий не обнаружено"
ALERT_PREFIX = "Прогнозируется атака! Тип: "
ALERT_REGION = ", Регион: "
INCIDENT_LABEL = "Инцидент "
THREAT_LABEL = "Угроза "
ELLIPSIS = "..."

# --- fixed values: thresholds ---
WEEKEND_DAYS = (5, 6)
NIGHT_FROM_HOUR = 22
NIGHT_TO_HOUR = 5
WORK_FROM_HOUR = 9
WORK_TO_HOUR = 18
RECENT_SECONDS = 5
ALERT_LATCH_SECONDS = 300
THREAT_MIN_SUPPORT = 10
INDUSTRY_MIN_SUPPORT = 5
TOP_K = 10
DESCRIPTION_WIDTH = 50
SOURCE_WIDTH = 40
TEST_FRACTION = 0.2
SPLIT_SEED = 42
IMPORTANCE_QUANTILE = 0.3
K_RANGE = tuple(range(2, 11))

# --- fixed values: display headers of the incident columns ---
INCIDENT_HEADERS = {
    "enterprise_type": "Тип_предприятия",
    "enterprise_code": "Код_предприятия",
    "host_count": "Количество_хостов",
    "threat_code": "Код_реализованной_угрозы",
    "success": "Успех",
    "region": "Регион_размещения_предприятия",
    "incident_date": "Дата_инцидента",
    "incident_time": "Региональное_время",
}
THREAT_HEADERS = {
    "threat_id": "Код_угрозы",
    "name": "Название_угрозы",
}

# --- fixed values: headers of the threat catalogue sheet (second row) ---
CATALOGUE_HEADERS = {
    "Идентификатор УБИ": "threat_id",
    "Наименование УБИ": "name",
    "Описание": "description",
    "Источник угрозы (характеристика и потенциал нарушителя)": "threat_source",
    "Объект воздействия": "target_object",
    "Нарушение конфиденциальности": "confidentiality_breach",
    "Нарушение целостности": "integrity_breach",
    "Нарушение доступности": "availability_breach",
    "Дата включения угрозы в БнД УБИ": "date_added",
    "Дата последнего изменения данных": "last_modified",
    "Статус угрозы": "status",
    "Замечания": "notes",
}

# --- fixed values: headers of the incident sheet ---
INCIDENT_SHEET_HEADERS = {
    "Тип предприятия": "enterprise_type",
    "Код предприятия": "enterprise_code",
    "Количество хостов": "host_count",
    "Код реализованной угрозы": "threat_code",
    "Успех": "success",
    "Регион размещения предприятия": "region",
    "Дата инцидента": "incident_date",
    "Региональное время": "incident_time",
}

# --- fixed values: recommendation lines of the report (format strings) ---
REC_TIME = "1. Временная защита: усилить мониторинг в {hour}:00, по {dow}-му дню недели и в {month}-м месяце."
REC_INDUSTRY = "2. Отраслевая защита: особое внимание уделить отраслям {items}."
REC_REGION = "3. Региональная защита: повышенный контроль в регионах {items}."
REC_THREAT = "4. По угрозам: сконцентрироваться на предотвращении следующих типов атак: {items}."
REC_CLUSTER = "5. Кластеры высокого риска: {items}"
REC_FACTORS = "6. Ключевые факторы успешной атаки: {items}"
REC_ARCH = "7. Архитектура безопасности: внедрить систему раннего предупреждения на основе улучшенной модели."

# --- fixed values: lines of the forecast text (format strings) ---
FORECAST_RULE = "=" * 50
FORECAST_HEADING = "Прогнозируется атака"
FORECAST_REGION = "   Регион:          "
FORECAST_INDUSTRY = "   Отрасль:         "
FORECAST_TIME = "   Время атаки:     %s:00 (День %d)"
FORECAST_CHANCE = "   Вероятность успеха: %.2f%%"
