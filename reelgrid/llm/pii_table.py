"""The small labelled table of the personal-data field: sentences with slots, filled with invented data.

The sentences are of everyday Vietnamese and English: shops, schools, hospitals, offices, deliveries,
sports, travel, machines. A sentence is a list of (text, kind) parts; kind '' is plain text. Names are
put together from common and from random syllables, roads and numbers from random ones, so nothing
about them can be learnt but their shape and what stands around them.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np

# Slots: {P} person, {E} email, {F} phone, {S} spoken phone, {I} identity number, {A} address in Vietnamese ({p} and {a} the
# same in lower case), {B} address in English, {Q} person in English; not personal: {N} small number, {X} place or road name,
# {O} organisation, {C} code, {K} order code, {D} ten digits, {V} large count, {U} channel; {g} and {G} a short plain clause.
WITH_DATA = [
    "Cần tư vấn thì nhắn {P}, máy {F}.", "Khách {P} đặt cọc qua {F}, hẹn nhận xe thứ bảy.", "Thẻ của {P} mang mã {I} bị khoá.", "Hoá đơn xin gửi {E}, cảm ơn shop.", "Giao hàng tới {A}, gọi trước {F}.", "Em {P} lớp 9B quên cặp ở phòng thí nghiệm.", "Thầy {P} dạy toán, cô {P} dạy nhạc.", "Bệnh nhân {P}, số căn cước {I}, nhập viện lúc {N} giờ.", "Căn cước công dân số {I} đã hết hạn.", "CMND số {I} cấp tại {X}.",
    "Tên tôi là {P}, sinh năm {Y}, trú tại {A}.", "Tôi tên {P}, hiện thuê trọ ở {A}.", "Cháu tên {P} ạ, nhà cháu ở {A}.", "Mình là {P} bên kế toán, mail {E}.", "Hồ sơ ứng viên: {P}; thư điện tử {E}; di động {F}.", "Người ký: {P}", "Ký tên: {P}, {P}.", "Kính gửi ông {P}, phòng nhân sự.", "Thân gửi {P} và {P}, hẹn gặp ở {X}.", "Đạo diễn {P} cùng nhạc sĩ {P} ra mắt album.",
    "Cầu thủ {P} ghi bàn phút {N}.", "Ca sĩ {P} hát hai bài.", "Luật sư {P} bào chữa cho bị cáo.", "Theo bác sĩ {P}, {g}.", "Phóng viên {P} tường thuật.", "MC {P} mở màn.", "{P} cho biết {g}.", "{P}, {N} tuổi, {g}.", "{P} nói thêm rằng {g}.", "{P} và {P} cùng {g}.", "Bà {P} kể {g}.", "Ông {P} bảo {g}.", "Chị {P} nhờ {g}.", "Anh {P} hứa sẽ {g}.", "Cô {P} dặn {g}.", "Chú {P} đang {g}.", "Bác {P} vừa {g}.", "Cụ {P} năm nay {N} tuổi.", "Lúc ấy {P} {g}.", "Sau đó {P} {g}.", "Khi {P} tới, {g}.", "Vì {P} bận nên {g}.", "Chúc mừng {P} đạt giải nhất!", "Xin cảm ơn {P} nhiều!", "Nhờ {P} gọi lại {F} giúp.", "Trò chuyện với {P} tại {X}.", "Gặp gỡ {P} sau buổi tập ở {X}.", "Bài: {P}. Ảnh: {P}.", "Âm thanh: {P}; ánh sáng: {P}.", "Kịch bản: {P}; phục trang: {P}; thư về {E}.",
    "Thư góp ý về {E} nhé.", "Gửi bản sao vào {E} trước {N} giờ.", "Đăng ký tại {E} hoặc {F}.", "Tài khoản {E} không đăng nhập được.", "Ai cần vé thì viết cho {E}.", "Địa chỉ thư của tôi: {E}", "Bạn ghi giúp mail nhé: {E}", "Đường dây nóng {F} hoạt động cả đêm.", "Số {F} gọi mãi chẳng ai nhấc.", "Máy bàn {F}, máy lẻ {N}.", "Sđt: {F}", "Zalo {F} gặp {P}.", "ĐT {F}, gặp chị {P} buổi chiều.", "Alo {F} để đặt bàn.", "Có gì báo vào {F} nha.", "Ai thấy chó lạc xin báo {F}.",
    "Nhặt được ví có căn cước {I} mang tên {P}.", "Rơi giấy phép lái xe {I} gần {X}, ai thấy báo {F}.", "Hộ chiếu số {I} của {P} chờ ở quầy.", "Passport {I} bị thất lạc, báo {E}.", "Số định danh {I} nhập sai.", "Mã căn cước {I} trùng với hồ sơ cũ.", "Giấy tờ tuỳ thân {I} chưa công chứng.", "Bảo hiểm của {P}, định danh {I}, hết hạn.",
    "Cửa hàng ở {A} đã dời.", "Tiệm bánh {A} mở cửa sớm.", "Bưu kiện chuyển về {A}, người nhận {P}.", "Bưu kiện chuyển về số nhà {A}.", "Cho thuê phòng ở {A}, gọi {F}.", "Hẹn nhau trước nhà {A}.", "Thợ sửa ống đã sang nhà số {A}.", "Văn phòng đặt ở số {A}.", "Địa chỉ: {A}", "Xe cấp cứu tới {A} lúc {N} giờ.", "Ông {P} ngụ {A}, {g}.", "Bà {P} sống ở {A} đã {N} năm.",
    "Gọi điện {P} theo máy {F}.", "Nhắn tin {P} nhé.", "Xin gặp {P} ở quầy {N}.", "Hỏi thăm {P} giúp tôi.", "Tìm kiếm {P} mấy hôm nay.", "Mời gặp {P}, máy {F}.", "Đề nghị {P} bổ sung hồ sơ.", "Liên lạc {P} bằng {F}.", "Thông báo {P} trúng thưởng.", "Yêu cầu {P} nộp lại giấy.", "Nhường ghế {P} vì {g}.", "Đặt lịch {P} qua {E}.",
    "Để quên giấy tờ {I} trên xe buýt.", "Kèm CCCD {I} và ảnh thẻ.", "Sổ hộ khẩu ghi CCCD {I}.", "Người nộp {P}, CCCD {I}.", "Khách thuê {P}, CMND {I}, máy {F}.", "Bằng lái {I} quá hạn.", "Thẻ cư trú {I} mang tên {P}.", "Giấy tờ {I} chủ là {P}.", "Visa {I} bị từ chối.",
    "anh {p} bảo {G}", "chị {p} hỏi {G}", "ông {p} ở {a} gọi hỏi {G}", "bà {p} nhà ở {a} muốn {G}", "cô {p} thuê nhà {a} rồi", "chú {p} nhờ {G}", "bác {p} kể là {G}", "em là {p} ạ", "cháu tên là {p} cháu muốn hỏi {G}", "mình là {p} máy mình {F}", "dạ tôi là {p} tôi ở {a}", "vâng em tên {p} máy em {F} ạ", "số điện thoại của tôi {S} nhé", "anh ghi giúp số {S}", "máy của chị là {S} chị tên {p}", "alo có phải anh {p} không", "gặp chị {p} giúp em", "chị {p} với anh {p} đang {G}", "hôm qua anh {p} đã {G}", "thầy {p} dặn {G}",
    "Mail us at {E} or ring {F}.", "He answers at {E}.", "Support is found at {E}, day and night.", "She left her mail, {E}, on a card.", "Ship it to {Q}, {B}, today.", "We meet at {B}.", "{B} is for rent.", "Move the desk to {B}, please.", "ID {I} was typed twice.", "Card {I} is blocked.", "{I} is not valid.", "A letter for {Q}, {B}.",
    "Please call {Q} at {F} about the invoice.", "{Q} signed the lease for {B}.", "Deliver to {B} by noon.", "My name is {Q} and I live at {B}.", "Contact {Q} via {E}.", "Mr {Q} asked for a refund.", "Mrs {Q} teaches piano.", "Dr {Q} saw nine patients.", "Ms {Q} joined the team on Monday.", "Thanks to {Q} for the photos.", "{Q} moved to the north last year.", "{Q}, our accountant, will reply from {E}.", "Refund goes to {Q}, {B}.", "Her card number {I} was copied.", "License {I} expired in May.", "Passport number {I} was reported lost.", "Document {I} is issued to {Q}.", "Text {F} or mail {E} for details.", "The tenant at {B} left the key.", "Photo by {Q}.", "Written by {Q} and {Q}.", "Talk with {Q}; booking through {E} or {F}.", "Dear {Q}, the shipment to {B} is late.", "The owner, {Q}, can be reached on {F}.", "{I} is the id of {Q}.",
]
WITHOUT = [
    "Đơn {K} đã giao xong.", "Mã vận đơn {K} chưa cập nhật.", "Phiếu {K} thuộc kho {N3}.", "Mã sản phẩm 893{D} hết hàng.", "Quét mã 893{D} ở quầy {N}.", "Kênh @{U} vừa đăng clip mới.", "Theo dõi @{U} để xem thêm.", "Bài hát có {V} lượt nghe.", "Trang web đón {V} lượt truy cập trong {N} tuần.", "Doanh thu {V} đồng.", "Giá vàng lên {N},{N} triệu.", "Điểm chuẩn {N},{N}.", "Nhà máy làm ra {N4} tấn thép.", "Tỉ số {N}-{N} nghiêng về đội {X}.", "Máy bay hạ cánh ở {X} lúc {N}:{N}.", "Ảnh {N4} x {N4} điểm.", "Bản {N}.{N}.{N} sửa lỗi in ấn.", "Tập tin {C} hỏng.", "Cuốn {C} dài {N} phút.", "Lô {N3} lấy mẫu lần {N}.", "Toà nhà {X} cao {N} tầng.", "Lầu {N} chung cư {X} mất nước.", "Quốc lộ {N} qua {X} kẹt cứng.", "Đại lộ {X} thông xe.", "Đường {X} cấm tải.", "Phố {X} treo đèn.", "Cầu {X} sửa xong.", "Chợ {X} họp phiên.", "Hồ {X} cạn.", "Núi {X} có mây.", "Sông {X} chảy xiết.", "Làng {X} dệt lụa.", "Thôn {X} có điện.", "Xã {X} lên phường.", "Phường {X} mở lớp bơi.", "Quận {X} trồng cây.", "Huyện {X} được mùa.", "Tỉnh {X} đón khách.", "Thành phố {X} có mưa.", "Thị trấn {X} họp chợ đêm.", "Bến xe {X} đông nghịt.", "Sân bay {X} hoãn chuyến.", "Ga {X} thêm toa.", "Trường {X} khai giảng.", "Công viên {X} đóng cửa.", "Khách sạn {X} kín phòng.", "Quán {X} bán phở.", "Rạp {X} chiếu phim.", "Bảo tàng {X} miễn vé.", "Chùa {X} lễ hội.", "Đội {X} thua đội {X}.", "Hãng {X} ra xe mới.", "Nhà hát {X} diễn vở mới tối nay.", "Bệnh viện {X} thêm giường.",
    "Tạp chí số {N3}, {g}.", "Báo cáo số {N3}, {g}.", "Theo công văn số {N3}, {g}.", "theo nghị định số {N3} {G}", "Kỳ số {N3}: {g}.", "Tập số {N}, {g}.", "Quyết định số {N3} có hiệu lực.", "Xe số {N} tới muộn.", "Bàn số {N}, {N} khách.", "Câu hỏi số {N}: {g}?", "Đề số {N3} khá khó.", "Clip có {V} người thích.", "Quỹ còn {V} đồng sau {N} tháng.", "Cả nước có {V} hộ dân.", "Đếm được {V} hạt giống.", "ở {x} {G}", "về {x} {G}", "tại {x} có {N} người {G}", "{G} ở {x} cả ngày", "{G} ở {x} hôm kia rồi {G}", "mưa to ở {x} nên {G}", "{G} gần {x}", "Quét lá rụng ở {X} cả buổi.", "Khách du lịch đổ về {X} dịp lễ.", "Trời {X} se lạnh.", "Dân {X} quen rồi.",
    "{O} tuyển {N} kế toán.", "{O} khai trương.", "{O} gửi quà cho trẻ em.", "{O} ký kết với {O}.", "Cảm ơn {O} đã đồng hành.", "Chuyển phát tới {O}.", "Hội thảo của {O} hoãn lại.", "Giải thưởng do {O} trao.", "{g} ở {X}.", "{g} tại {X}.", "Ở {X}, {g}.", "Tại {X}, {g} và {g}.", "Từ {X} về {X} mất {N} giờ.", "{g} gần {X} hôm nay.", "{g}, {g}.", "{g}; {g}.", "{g} rồi {g}.", "{g}", "{G}", "{G} ở {x}", "{G} tại {x} lúc {N} giờ", "{G} rồi {G}", "Hôm nay {g}.", "Ngày mai {g}.", "Tháng {N} này {g}.", "Khoảng {N3} người {g}.", "Có {N3} ý kiến về việc {g}.", "Phần {N}: {g}, {g}.", "Câu {N}. {g}?", "Nhóm thợ {g}, bên kia mấy đứa trẻ {g}.", "Bác nông dân {g} ở {X}.", "Chị bán rau {g} từ sáng.", "Anh lái xe {g} rất cẩn thận.", "Cô hàng xóm {g} suốt buổi.", "Ông cụ {g} bên hiên.", "Bà ngoại {g} dưới bếp.", "Em bé {g} trong sân.", "Thầy hiệu trưởng {g}.", "Chú bảo vệ {g} ở cổng {X}.", "Bác sĩ trực {g} cả đêm.", "anh thợ mộc {G}", "chị lao công {G} ở {x}", "bà con trong xóm {G}", "ông chủ quán {G}", "cô giáo {G} cho học sinh", "chú công nhân {G} cạnh {x}", "mấy anh em {G}", "hai chị em {G} với nhau", "một hai cả nhóm đẩy", "ba bốn người {G}", "năm sáu chiếc xe {G}", "tám chín phần mười đồng ý",
    "GET /v{N}/items?id={N4} 200", "ERROR: cannot open {C}.mp4 (code {N3})", "[INFO] batch {N4} done in {N}.{N}s", "rm -rf /tmp/{C}", '{{"id": {N4}, "ok": true}}', "UPDATE stock SET n = {N3} WHERE id = {N4};", "for i in range({N3}): print(i)", "ping 10.{N}.{N}.{N} timeout", "https://shop.example/p/{N4}?ref={C}", "commit {D} fixes the parser", "Bảng {N}: kết quả thử nghiệm.", "Trang {N}/{N3}", "{N}h{N} phút", "Ngày {N}/{N}/{Y}", "Năm {Y}, {g}.", "{N}%", "Áo size {N} giá {N3}k.", "Nhiệt kế chỉ {N},{N} độ C.", "Gió giật cấp {N}.",
    "The {X} bridge is closed.", "{X} Street is under repair.", "Trains to {X} leave at {N}:{N}.", "{X} beat {X} {N}-{N}.", "Order {K} was shipped.", "Invoice {N4} is overdue.", "Version {N}.{N} adds {N} icons.", "Room {N3} is on floor {N}.", "{h}.", "{h} for {N} minutes.", "{h}, then {h}.", "Two students {h} near {X}.", "A farmer {h}; the light is dim.", "The tall waiter {h} while the cook {h}.", "Page {N3} explains why a nurse {h}.", "In the picture a boy {h}.", "Visit {X} Park in May.", "The {X} Hotel has {N3} rooms.", "Barcode 893{D} is unreadable.", "A note is pinned at the door, then a clerk {h}.", "The light at the top is broken; {h}.", "Look at page {N}.", "The show starts at {N} o'clock.", "In the second scene a cook {h}, the lamp at the side is on.", "a man {h} at the old mill and a girl {h}", "thick fog and a boy {h}", "far away two dogs sleep while a clerk {h}", "Quiet street, soft rain, then a driver {h}.", "QUIET STREET, SOFT RAIN, NOBODY AT THE DOOR.", "Follow @{U} for more.", "{O} opens a branch.",
]
# Short plain clauses of everyday life, in Vietnamese and English.
CLAUSES = "mua thêm rau cho bữa tối; đọc sách trong thư viện; rửa xe ngoài ngõ; nấu nồi chè đậu; họp với khách hàng; sửa lại mái tôn; tập đàn mỗi chiều; đi chợ từ sớm; trả tiền điện; quên chìa khoá; viết báo cáo quý; thay bóng đèn hành lang; chơi cờ với bạn; hái chè trên nương; đợi xe buýt; gói quà sinh nhật; lái xe về quê; phơi áo ngoài sân; xếp hàng lấy số; kiểm tra hoá đơn; chụp ảnh cưới; dạy con làm toán; trồng hoa hồng; chờ kết quả xét nghiệm; bán hết vé; mượn cái thang; uống cà phê; giặt rèm cửa; vẽ bức tường mới; cân lại bao gạo; in tờ rơi; chuyển nhà; gọi thợ sửa nước; khám răng; nghe nhạc cũ; cắt cỏ; nộp đơn xin nghỉ; ủi đồng phục; bơm bánh xe; nướng bánh; thi bằng lái; đổi tiền lẻ; cho mèo ăn; ghi chép cẩn thận; mở tiệm tạp hoá; cứu con chim non; tắt máy lạnh; quét lá rụng; đóng gói đơn hàng; tham gia hiến máu; giá xăng tăng nhẹ; trời trở lạnh; đường rất trơn; lớp học bắt đầu trễ; mọi thứ đã sẵn sàng; máy in lại kẹt giấy; khách đông hơn dự kiến; không ai trả lời; chuyến đi bị hoãn; cả nhà cùng ra đón; chấm bài cho lớp bên; xem bảng điểm; bà cụ lưng còng; món này chấm muối ớt; đánh dấu chấm cuối câu".split("; ")
CLAUSES_EN = "buys bread; fixes the old radio; reads the timetable; waits for the bus; plants tomatoes; cleans the windows; counts the coins; carries two bags; opens the shop; writes a letter; feeds the cat; checks the tyres; plays the drums; cooks rice; draws a map; sells tickets; looks at the clock; waits at the gate; sits at the table by the stove; laughs at the joke; arrives at noon; stays at home with the twins; points at a dot on the screen; stops at the corner; stares at the ceiling; works at night".split("; ")
_SURNAMES = "Nguyễn Trần Lê Phạm Hoàng Huỳnh Phan Vũ Võ Đặng Bùi Đỗ Hồ Ngô Dương Lý Đinh Mai Trịnh Cao Lưu Tạ".split()
_MIDDLE = "Văn Thị Hữu Đức Minh Thanh Ngọc Quốc Thu Hồng Kim Xuân Bảo Gia Anh Đình Công Như Phương Tuấn".split()
_GIVEN = "An Bình Chi Dũng Giang Hà Hải Hạnh Hiếu Hoa Hùng Huy Hương Khánh Khoa Lan Linh Long Mai Minh Nam Nga Ngân Nhung Phong Phúc Quân Quỳnh Sơn Tâm Thảo Thắng Thuỷ Tiến Trang Trung Tú Tuấn Tùng Việt Vy Yến".split()
_FIRST_EN = "John Mary James Linda Robert Susan Michael Karen David Lisa Thomas Nancy Daniel Emma Paul Laura Mark Helen George Anna Peter Alice".split()
_LAST_EN = "Smith Miller Johnson Brown Davis Wilson Taylor Moore Clark Lewis Walker Hall Young King Wright Baker Carter Turner Parker Cook".split()
_MAIL = ["gmail.com", "yahoo.com", "outlook.com", "hotmail.com", "icloud.com", "vnmail.vn", "hcmut.edu.vn", "company.com", "mail.org"]
_ONSETS = "b c ch d đ g gi h k kh l m n ng nh ph qu r s t th tr v x".split()
_VOWELS = "a ă â e ê i o ô ơ u ư oa oe uy iê uô ươ oă uyê".split()
_CODAS = ["", "", "c", "ch", "i", "m", "n", "ng", "nh", "p", "t", "u", "o"]
_TONES = ["", "̀", "́", "̉", "̃", "̣"]
_FIELDS = ["Dược phẩm", "Bóng đá", "Du lịch", "Đồ gỗ", "Thuỷ sản", "Môi trường", "Quảng cáo", "Giáo dục", "Xây dựng", "Điện lạnh"]
_BODIES = ["Trung tâm", "Trường Đại học", "Bệnh viện", "Hợp tác xã", "Hiệp hội", "Câu lạc bộ", "Nhà xuất bản", "Công ty cổ phần", "Công ty TNHH", "Ngân hàng", "Viện", "Sở", "Tập đoàn"]
_SPOKEN = ["không", "một", "hai", "ba", "bốn", "năm", "sáu", "bảy", "tám", "chín"]


class _Maker:
    def __init__(self, seed: int):
        self.rng = np.random.default_rng(seed)

    def pick(self, xs):
        return xs[int(self.rng.integers(len(xs)))]

    def digits(self, n: int) -> str:
        return "".join(map(str, self.rng.integers(0, 10, n)))

    def syllable(self) -> str:
        v = self.pick(_VOWELS)
        s = self.pick(_ONSETS) + v[0:-1] + v[-1] + self.pick(_TONES) + self.pick(_CODAS)
        return unicodedata.normalize("NFC", s).capitalize()

    def english(self, pick: list[str] | None = None) -> str:
        if pick and self.rng.random() < 0.4:
            return self.pick(pick)
        return ("".join(self.pick(["ba", "cor", "dun", "el", "fen", "ha", "jor", "li", "ma", "nes", "or", "pel", "quen", "ros", "sel", "tor", "var", "wys", "yar", "dith", "mer"]) for _ in range(2)) + self.pick(["", "n", "ck", "row", "gate", "by", "more", "s"])).capitalize()

    def name(self, n: int | None = None, person: bool = False) -> str:
        n = n or self.pick([2, 3, 3, 3, 3, 3, 4])
        if person and self.rng.random() < 0.5:
            words = [self.pick(_SURNAMES), *(self.pick(_MIDDLE) for _ in range(n - 2)), self.pick(_GIVEN)]
        else:
            words = [self.syllable() for _ in range(n)]
        s, style = " ".join(words), self.rng.random()
        return s.upper() if style < 0.1 else plain(s) if style < 0.25 else s

    def place(self) -> str:
        return self.name(2) if self.rng.random() < 0.9 else self.english()

    def address(self) -> str:
        x = lambda: " ".join((self.syllable(), self.syllable()))
        n, m = int(self.rng.integers(1, 400)), int(self.rng.integers(1, 99))
        return self.pick([
            f"{n} ngõ {m} đường {x()}", f"{n} ngách {m}/{int(self.rng.integers(1, 90))} phố {x()}, quận {x()}", f"{n}{self.pick('ABC')} phố {x()}", f"{n}, tổ {m}, thôn {x()}, xã {x()}", f"{n} đường {x()}, phường {x()}", f"{n}/{m} {x()}, P. {x()}",
            f"{n} Đ. {x()}, TP. {x()}", f"{n}/{m} {x()}, P. {x()}, TP. {x()}", f"{n} phố {x()}", f"{n} hẻm {m} đường {x()}, Q. {m}", f"{n}/{m}/{m} đường {x()}, quận {x()}",
        ])

    def english_address(self) -> str:
        n = int(self.rng.integers(1, 900))
        road = self.pick(["Street", "Lane", "Avenue", "Court", "Road", "Drive"])
        return f"{n}{self.pick(['', '', '', 'B', 'A'])} {self.pick(['', '', 'North ', 'South ', 'East '])}{self.english()} {road}{self.pick(['', '', f', Apt {int(self.rng.integers(1, 40))}'])}"

    def phone(self) -> str:
        if self.rng.random() < 0.2:
            d = self.digits(4)
            return self.pick(["+1-555-555-{}", "(555) 555-{}", "555-555-{}", "+1 555 555 {}", "+1 (555) 555-{}", "555.555.{}"]).format(d)
        a, d = self.pick(["3", "5", "7", "8", "9"]) + self.digits(1), self.digits(7)
        if self.rng.random() < 0.25:
            d8 = self.digits(7)
            return self.pick([f"(02{self.digits(2)}) 3{d8[0]} {d8[1:4]} {d8[4:6]}", f"02{self.digits(2)}.3{d8[:3]}.{d8[3:6]}", f"02{self.digits(1)} 3{d8[:3]} {d8[3:]}", f"02{self.digits(2)} 3{d8[:6]}", f"02{self.digits(2)}3{d8[:6]}"])
        return self.pick([
            f"0{a}{d}", f"0{a}{d}", f"84{a}{d}", f"+84{a}{d}", f"+84 {a} {d[:3]} {d[3:]}", f"(+84) {a}{d[0]} {d[1:4]} {d[4:]}", f"0{a}{d[0]} {d[1:4]} {d[4:]}", f"0{a}{d[0]}.{d[1:4]}.{d[4:]}", f"0{a}-{d[:3]}-{d[3:]}", f"0{a} {d[:2]} {d[2:4]} {d[4:]}", f"0{a}{d[:1]}-{d[1:4]}-{d[4:]}",
        ])

    def identity(self) -> str:
        d, e = "0" + self.pick(["97", "98", "99", "01", "79", "36", "31"]) + self.digits(9), self.pick(["97", "98", "12", "24", "36"]) + self.digits(7)
        return self.pick([d, d, e, e, f"{e[:3]} {e[3:6]} {e[6:]}", f"{d[:4]} {d[4:8]} {d[8:]}", f"{d[:4]}-{d[4:8]}-{d[8:]}", f"{d[:4]}.{d[4:8]}.{d[8:]}", f"{d[:3]} {d[3]} {d[4:6]} {d[6:]}", f"{self.pick('ABCDEGHKLMNPQRSTVXYZ')}{self.digits(7)}", f"{self.pick('ABCDEGHKLMNPQRSTVXYZ')}{self.digits(7)}", f"{e[:3]}.{e[3:6]}.{e[6:]}"])

    def email(self) -> str:
        a, b = (plain(self.syllable()).lower() for _ in range(2))
        n = int(self.rng.integers(1, 99))
        who = self.pick([f"{a}.{b}", f"{a}_{b}", f"{a}-{b}", f"{a}{b}{n}", f"{a}+phim", f"{a[0]}.{b}.{1950 + n % 60}", f"{a}{n}", f"{a[0]}.{b}"])
        host = self.pick(_MAIL).split(".") if self.rng.random() < 0.4 else self.pick([[a + b, "example"], [b, "invalid"], ["mail", a, "test"], ["x-" + b, "test"], [a, b, "vn"], [b + "-" + a, "com"], [a, "org"]])
        words = list(host)
        style = self.rng.random()
        if style < 0.6:
            s = who + "@" + ".".join(words)
        elif style < 0.68:
            s = who + " [at] " + " [dot] ".join(words)
        elif style < 0.76:
            s = who + " a còng " + " chấm ".join(words)
        elif style < 0.86:
            s = who + self.pick([" (at) ", " @ "]) + ".".join(words)
        elif style < 0.9:
            s = who + "＠" + ".".join(words)
        else:
            s = who + self.pick([" at ", "(at)", "[at]"]) + self.pick([" dot ", "(dot)", "[dot]", " (dot) "]).join(words)
        return s.upper() if self.rng.random() < 0.12 else s.capitalize() if self.rng.random() < 0.08 else s

    def fill(self, slot: str) -> tuple[str, str]:
        n = int(self.rng.integers(1, 99))
        if slot == "P":
            return self.name(person=True), "person"
        if slot in "pa":  # as a speech recogniser writes it
            text, kind = self.fill(slot.upper())
            return text.lower(), kind
        if slot == "Q":
            middle = self.pick(["", "", f"{self.pick('ABCDEHKLT')}. "])
            return f"{self.english(_FIRST_EN)} {middle}{self.english(_LAST_EN)}", "person"
        if slot == "S":
            return " ".join(["không", *(self.pick(_SPOKEN) for _ in range(9))]), "phone"
        made = {"E": (self.email, "email"), "F": (self.phone, "phone"), "I": (self.identity, "id_number"), "A": (self.address, "address"), "B": (self.english_address, "address")}
        if slot in made:
            f, kind = made[slot]
            return f(), kind
        plain_slots = {"N": str(n), "N3": str(n * 7), "N4": str(n * 97 + 1000), "D": self.digits(10), "V": f"{int(self.rng.integers(1, 1000))}.{self.digits(3)}.{self.digits(3)}", "C": f"L{n:02d}_V{self.digits(3)}", "U": f"{plain(self.syllable()).lower()}_{n}", "K": f"{self.pick(['HD', 'PX', 'VN', 'SO', 'OD'])}-{n * 97 + 1000}-{n}", "Y": str(1950 + n % 70)}
        if slot == "O":
            return f"{self.pick(_BODIES)} {self.pick(_FIELDS)} {self.name(2)}", "other"
        if slot == "x":
            return self.place().lower(), "other"
        return (plain_slots[slot], "other") if slot in plain_slots else (self.place(), "other")


def plain(s: str) -> str:
    """Without accents."""
    return "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c)).replace("đ", "d").replace("Đ", "D")


def held_out(template: str) -> bool:
    """Whether a template is one of the fifth that only measures."""
    return sum(template.encode()) % 5 == 0


def labelled_rows(rows: int, seed: int, measured: bool | None = False) -> list[list[tuple[str, str]]]:
    """The table: each row one to three sentences as parts.

    ``measured``: False for the templates that train, True for those that are held out, None for all.
    """
    make = _Maker(seed)
    with_data, without = ([t for t in x if measured is None or held_out(t) == measured] for x in (WITH_DATA, WITHOUT))
    out = []
    for _ in range(rows):
        parts: list[tuple[str, str]] = []
        for _ in range(make.pick([1, 2, 2, 3])):
            s = make.pick(with_data) if make.rng.random() < 0.55 else make.pick(without)
            s = s.replace("{{", "\x02").replace("}}", "\x03")
            sentence: list[tuple[str, str]] = []
            for piece in re.split(r"(\{\w+\})", s):
                slot = piece[1:-1] if piece[:1] == "{" else ""
                if slot in ("g", "G"):
                    sentence.append((make.pick(CLAUSES), ""))
                elif slot == "h":
                    sentence.append((make.pick(CLAUSES_EN), ""))
                elif slot:
                    sentence.append(make.fill(slot))
                elif piece:
                    sentence.append((piece.replace("\x02", "{").replace("\x03", "}"), ""))
            spoken = "{p}" in s or "{a}" in s or "{S}" in s or "{G}" in s
            style = make.rng.random()
            if not spoken and sentence[0][1] == "":
                sentence[0] = (sentence[0][0][:1].upper() + sentence[0][0][1:], "")
            if style < 0.08:
                sentence = [(t if kind else plain(t), kind) for t, kind in sentence]
            elif style < 0.16:
                sentence = [(t if kind else t.lower(), kind) for t, kind in sentence]
            elif style < 0.25 and all(kind in ("", "other") for _, kind in sentence):
                sentence = [(plain(t).upper(), kind) for t, kind in sentence]
            if style > 0.9 and not sentence[-1][1]:
                sentence[-1] = (sentence[-1][0].rstrip("."), "")
            if parts:
                parts.append((make.pick([" ", " ", " ", "\n"]), ""))
            parts += sentence
        out.append(parts)
    return out


def joined(parts: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int, str]]]:
    """The row's text and the places of its personal data."""
    text, spans = "", []
    for t, kind in parts:
        if kind and kind != "other":
            spans.append((len(text), len(text) + len(t), kind))
        text += t
    return text, spans
