"""Word lists, patterns and tables that results depend on, each in its own order."""

from __future__ import annotations

import string
import unicodedata

PUNCTUATION = string.punctuation

# --- Fixed values: document numbers -------------------------------------------------------------

NUMBER = r"(\d+[/-]\d{4}[/-]?[\w-]*)"

#: (implementing document, its parent document, order of the parents)
CROSS_REFERENCES = [
    ("71/2020/NĐ-CP", "43/2019/QH14", 0),
    ("71/2020/ND-CP", "43/2019/QH14", 0),
    ("84/2020/NĐ-CP", "43/2019/QH14", 0),
    ("84/2020/ND-CP", "43/2019/QH14", 0),
    ("105/2020/NĐ-CP", "43/2019/QH14", 0),
    ("105/2020/ND-CP", "43/2019/QH14", 0),
    ("116/2020/NĐ-CP", "43/2019/QH14", 0),
    ("116/2020/ND-CP", "43/2019/QH14", 0),
    ("238/2025/NĐ-CP", "43/2019/QH14", 0),
    ("238/2025/ND-CP", "43/2019/QH14", 0),
    ("99/2019/NĐ-CP", "34/2018/QH14", 0),
    ("99/2019/ND-CP", "34/2018/QH14", 0),
    ("08/2023/TT-BGDĐT", "01/2021/TT-BGDĐT", 0),
    ("08/2023/TT-BGDĐT", "02/2021/TT-BGDĐT", 1),
    ("08/2012/QH13", "34/2018/QH14", 0),
]

#: (order, text contained in an upper-case number, text also needed or "", canonical number)
CANONICAL_NUMBERS = [
    (0, "07/BGD", "", "07/BGDĐT-VBHN"),
    (1, "07/VBHN", "", "07/BGDĐT-VBHN"),
    (2, "NGHI DINH 07", "", "07/BGDĐT-VBHN"),
    (3, "124/2024", "", "124/2024/NĐ-CP"),
    (4, "202/2025", "", "202/2025/NĐ-CP"),
    (5, "238/2025", "", "238/2025/NĐ-CP"),
    (6, "116/2020", "", "116/2020/NĐ-CP"),
    (7, "105/2020", "", "105/2020/NĐ-CP"),
    (8, "311/2025", "", "311/2025/NĐ-CP"),
    (9, "339/2025", "", "339/2025/NĐ-CP"),
    (10, "43/2019", "", "43/2019/QH14"),
    (11, "34/2018", "", "34/2018/QH14"),
    (12, "84/2020", "", "84/2020/NĐ-CP"),
    (13, "71/2020", "", "71/2020/NĐ-CP"),
    (14, "86/2021", "", "86/2021/NĐ-CP"),
    (15, "22/2021", "", "22/2021/TT-BGDĐT"),
    (16, "24/2024", "", "24/2024/TT-BGDĐT"),
    (17, "32/2018", "", "32/2018/TT-BGDĐT"),
    (18, "05/2023", "", "05/2023/TT-BGDĐT"),
    (19, "08/2023", "", "08/2023/TT-BGDĐT"),
    (20, "01/2021", "", "01/2021/TT-BGDĐT"),
    (21, "02/2021", "", "02/2021/TT-BGDĐT"),
    (22, "03/2021", "", "03/2021/TT-BGDĐT"),
    (23, "04/2021", "ND", "04/2021/NĐ-CP"),
    (24, "04/2021", "NĐ", "04/2021/NĐ-CP"),
    (25, "04/2021", "NGHỊ ĐỊNH", "04/2021/NĐ-CP"),
    (26, "04/2021", "NGHI DINH", "04/2021/NĐ-CP"),
    (27, "04/2021", "", "04/2021/TT-BGDĐT"),
    (28, "08/2012", "", "08/2012/QH13"),
    (29, "30/2013", "", "30/2013/QH13"),
    (30, "20/2022", "", "20/2022/TT-BGDĐT"),
    (31, "05/2025", "", "05/2025/TT-BGDĐT"),
]

# --- Fixed values: article linking --------------------------------------------------------------

RIGHTS = ["quyen cua", "nhiem vu cua", "nghia vu cua"]
PROHIBITIONS = ["bi nghiem cam", "hanh vi bi cam", "hanh vi bi nghiem cam"]
ACTORS = ["nha giao", "giao vien", "hoc sinh", "sinh vien", "hieu truong"]
AMENDING = ["sua doi", "bo sung", "thay the"]
IMPLEMENTING = ["thi hanh", "hieu luc"]
CONCEPTS = ["cu tuyen", "mam non", "tieu hoc", "thcs", "thpt", "thinh giang", "day them", "xep luong", "boi hoan", "hoc bong chinh sach", "tu thuc", "nha giao", "bi nghiem cam"]

# --- Fixed values: query understanding ----------------------------------------------------------

INTENT_KEYWORDS = {
    "GREETING": ["xin chào", "chào bạn", "hello", "hi ", "hey", "chào"],
    "THANKS": ["cảm ơn", "thank", "cám ơn", "tks"],
    "SUMMARY": ["tóm tắt", "khái quát", "nội dung chính", "quy định những gì"],
    "STATISTICAL": ["bao nhiêu", "số lượng", "đếm", "thống kê"],
    "LISTING": ["liệt kê", "tất cả", "những trường hợp nào", "trường hợp nào", "những đối tượng nào", "đối tượng nào", "bao gồm những gì", "các loại", "kể tên"],
    "COMPARISON": ["so sánh", " vs ", "đối chiếu"],
    "UNANSWERABLE": ["top 100", "thế giới", "xếp hạng quốc tế"],
}
LOOKUP_CONTEXT = [
    "bồi hoàn", "mức", "phí", "lương", "trợ cấp", "hỗ trợ",
    "phạt", "tiền", "chi phí", "học phí", "tuổi", "học sinh",
    "lớp", "lâu", "năm", "tháng", "ngày", "tối đa", "tối thiểu",
    "giờ", "tiết", "điểm", "hạng",
]
LEGAL_KEYWORDS = [
    "điều", "khoản", "điểm", "luật", "nghị định", "thông tư", "quy định",
    "quyết định", "văn bản", "pháp luật", "hiến pháp", "quyền", "nghĩa vụ",
    "điều kiện", "tiêu chuẩn", "trách nhiệm", "xử phạt", "vi phạm",
    "hướng dẫn", "thi hành", "hiệu lực", "bãi bỏ", "sửa đổi", "bổ sung",
    "ban hành", "áp dụng", "chuyển đổi", "quyết nghị",
    "giáo viên", "nhà giáo", "giảng viên", "học sinh", "sinh viên",
    "trường", "đại học", "mầm non", "tiểu học", "trung học", "thcs", "thpt",
    "giáo dục", "đào tạo", "tuyển sinh", "học phí", "học bổng",
    "sư phạm", "chức danh", "nghề nghiệp", "thăng hạng", "bổ nhiệm",
    "hội đồng", "hiệu trưởng", "cơ sở giáo dục", "chương trình",
    "bằng cấp", "tốt nghiệp", "kỷ luật", "đánh giá", "kiểm tra",
    "nâng chuẩn", "du học", "cử tuyển", "bồi hoàn", "thỉnh giảng",
    "lợi nhuận", "tư thục", "công lập", "hỗ trợ", "chính sách",
    "khu công nghiệp", "dân tộc", "nội trú",
]
SUMMARY_PATTERNS = [
    r"nói về (gì|điều gì|cái gì|vấn đề gì)",
    r"quy định (gì|những gì|về gì|về vấn đề gì)",
    r"gồm (những gì|bao nhiêu|mấy)",
    r"bao gồm (những gì|nội dung gì)",
    r"tóm tắt",
    r"nội dung (chính|chủ yếu|tổng quan|cơ bản)",
    r"có (bao nhiêu|mấy) (chương|điều|mục|phần)",
    r"tổng quan",
    r"giới thiệu",
    r"cấu trúc",
    r"phạm vi điều chỉnh",
]
STATISTICAL_PATTERNS = [
    r"những (nghị định|thông tư|luật|văn bản|quy định) nào",
    r"liệt kê.*(nghị định|thông tư|luật|văn bản)",
    r"có (bao nhiêu|mấy) (nghị định|thông tư|luật|văn bản)",
    r"danh sách.*(nghị định|thông tư|luật|văn bản)",
    r"(nghị định|thông tư|luật|văn bản) nào.*(liên quan|nói về|quy định về|đề cập)",
    r"(năm|trong năm)\s+20\d{2}.*(nghị định|thông tư|luật|văn bản|ban hành|ra)",
    r"(nghị định|thông tư|luật|văn bản).*(năm|trong năm)\s+20\d{2}",
    r"ban hành.*(năm|trong năm)\s+20\d{2}",
    r"(ra|được ban hành).*(năm|trong)\s+20\d{2}",
]
#: (order, keywords, targets if any, conditions: (order, required, "all" or "any", targets))
ROUTING_RULES = [
    (0, ["nâng chuẩn", "trình độ chuẩn", "bằng cử nhân giáo viên"], ["71/2020/NĐ-CP"], []),
    (1, ["bổ nhiệm hạng", "thăng hạng", "hạng ii", "hạng iii"], [], [
        (0, ["mầm non"], "all", ["01/2021/TT-BGDĐT", "08/2023/TT-BGDĐT"]),
        (1, ["tiểu học"], "all", ["02/2021/TT-BGDĐT", "08/2023/TT-BGDĐT"]),
        (2, [], "all", ["01/2021/TT-BGDĐT", "08/2023/TT-BGDĐT"]),
    ]),
    (2, ["giữa kỳ", "cuối kỳ", "bài kiểm tra", "kiểm tra định kỳ", "kiểm tra thường xuyên", "nghỉ học nhiều", "ở lại lớp", "lên lớp", "tai nạn", "kiểm tra giữa kỳ", "nghỉ học quá 45 buổi"], ["22/2021/TT-BGDĐT"], []),
    (3, ["chuyển đổi"], [], [(0, ["đại học"], "all", ["34/2018/QH14", "99/2019/NĐ-CP"])]),
    (4, ["đại học tư thục", "không vì lợi nhuận", "hội đồng trường", "đại học y"], ["34/2018/QH14", "99/2019/NĐ-CP"], []),
    (5, ["thi tốt nghiệp", "tốt nghiệp thpt", "2026", "24/2024"], ["24/2024/TT-BGDĐT"], []),
    (6, ["tuyển sinh năm 2022", "tuyển sinh 2022", "tuyển sinh đại học"], ["08/2022/TT-BGDĐT"], []),
    (7, ["học bổng", "cử tuyển", "dự bị đại học", "nội trú"], ["84/2020/NĐ-CP"], []),
    (8, ["du học", "nghiên cứu khoa học nước ngoài", "gia hạn du học", "sinh viên cử đi học", "giảng viên đại học cử ra nước ngoài"], ["86/2021/NĐ-CP"], []),
    (9, ["sinh viên sư phạm", "hỗ trợ sinh hoạt phí", "bồi hoàn", "116/2020", "bảo lưu sư phạm"], ["116/2020/NĐ-CP"], []),
    (10, ["chuyển trường khác tỉnh", "giấy giới thiệu", "thủ tục chuyển trường"], ["43/2019/QH14"], []),
    (11, ["ngoại ngữ", "dạy ngoại ngữ", "ngoại ngữ 1", "chương trình giáo dục phổ thông 2018", "chương trình 2018"], ["32/2018/TT-BGDĐT"], []),
    (12, ["ngày pháp luật", "ngày pháp luật việt nam"], ["14/2012/QH13"], []),
    (13, ["học phí", "tiểu học", "không phải đóng học phí", "trường công lập"], ["43/2019/QH14"], []),
    (14, ["giảng viên", "chuẩn giảng viên", "chuẩn tối thiểu"], ["34/2018/QH14"], []),
    (15, ["chế độ làm việc", "nghỉ hè hằng năm", "nghỉ hè của nhà giáo", "tuổi nghỉ hưu của nhà giáo"], ["Luật 73/2025/QH15"], []),
    (16, ["hòa nhập", "giáo dục hòa nhập", "trung tâm hỗ trợ", "phạm vi điều chỉnh"], ["20/2022/TT-BGDĐT"], []),
    (17, ["nhiệm kỳ", "hiệu trưởng", "nhiệm kỳ của hiệu trưởng"], ["08/2012/QH13", "34/2018/QH14"], []),
    (18, ["quốc phòng", "an ninh", "quốc phòng và an ninh", "chính khóa"], ["30/2013/QH13"], []),
    (19, ["giảm 02 tiết", "giảm 2 tiết", "hội đồng trường", "kiêm nhiệm chủ tịch"], ["05/2025/TT-BGDĐT"], []),
    (20, ["05 năm ở nước ngoài", "ít nhất 05 năm", "liên kết giáo dục", "bên nước ngoài"], ["124/2024/NĐ-CP", "202/2025/NĐ-CP"], []),
    (21, ["sáp nhập", "chia, tách", "chia tách trường tiểu học", "ubnd cấp huyện"], ["07/BGDĐT-VBHN"], []),
    (22, ["trường học an toàn", "tai nạn thương tích"], [], [
        (0, ["mầm non"], "all", ["45/2021/TT-BGDĐT"]),
        (1, ["phổ thông", "thường xuyên", "thcs", "thpt", "tiểu học", "cấp 1", "cấp 2", "cấp 3"], "any", ["18/2023/TT-BGDĐT"]),
    ]),
]
TITLE_STOP_WORDS = ["về", "việc", "trong", "của", "và", "các", "cho", "cơ", "sở", "giáo", "dục"]
TITLE_LEAD = r"^(thông tư|nghị định|luật|quyết định)\s*(hướng dẫn|quy định về việc|quy định về|quy định)?\s*"
PROBE_STOP_WORDS = [
    "như", "thế", "nào", "gì", "có", "được", "không", "của", "cho", "khi",
    "thì", "phải", "theo", "là", "bao", "nhiêu", "những", "các", "trong",
    "về", "tại", "hay", "cần", "làm", "đối", "với", "này", "và", "hoặc",
    "đã", "sẽ", "đang", "một", "mà", "để", "từ", "quy", "định", "hãy",
    "liệt", "tất", "tóm", "tắt",
]
CONDITION_MARKERS = ["nếu", "khi", "trong trường hợp", "đối với", "điều kiện"]

# --- By rule ------------------------------------------------------------------------------------


def accent_table() -> tuple[str, str]:
    """(accented lower-case letters, their base letters) of the Latin blocks, by decomposition."""
    src, dst = ["đ"], ["d"]
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        c = chr(code)
        base = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
        if c == c.lower() and len(base) == 1 and base != c:
            src.append(c)
            dst.append(base)
    return "".join(src), "".join(dst)

#: Replies to questions that need no search, by intent.
REPLIES = {
    "GREETING": "Xin chào! 👋 Tôi là trợ lý AI chuyên về pháp luật giáo dục Việt Nam.\nBạn có thể hỏi tôi về Luật, Nghị định, Thông tư liên quan đến giáo dục.\nHãy đặt câu hỏi để tôi giúp bạn!",
    "THANKS": "Không có gì! 😊 Nếu bạn có thêm câu hỏi, đừng ngần ngại hỏi nhé.",
    "UNANSWERABLE": "Câu hỏi này nằm ngoài phạm vi cơ sở dữ liệu pháp luật giáo dục VN.",
}
#: Numbers of procedural documents, whose tables of contents have no snippets.
DISTRACTORS = ["13/2024", "125/2024", "238/2025", "04/2021"]
