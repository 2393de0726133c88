import pytest
from pyspark.sql import functions as F

from annolake.llm import residue as r

BAD = ["Chào {{ ten_khach }}, đơn đã ghi nhận.", "Mua ${price} hôm nay.", "Dear <%= NAME %>, hello.", "{LINK-QUA} chính hãng", "Tên: %s, số lượng: %d", "(điền tên khách) thân mến,", "[chèn mô tả ngắn vào đây]", "Nhãn hiệu: [object Object]", "Thương hiệu: undefined", "Giá: NaN ₫", "Kính gửi ............, mã đơn xxxxxxx",
       "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "abc abc abc abc", "asdf asdf asdf qwer qwer", "Đây là đoạn văn bản mẫu, dùng để xem bố cục trang.", "TODO: bổ sung bảng thành phần trước khi đăng.", "Phần này viết sau (nháp)", "Lỗi 404!", "HTTP 504 GATEWAY TIMEOUT", "LOI 502 - DICH VU TAM NGUNG.", "Máy chủ không phản hồi.",
       "Sản phẩm không tồn tại hoặc đã bị gỡ.", "Access denied.", "Vui lòng bật JavaScript để tiếp tục sử dụng trang.", "You need to enable JavaScript to run this app.", "Xác minh bạn không phải là người máy trước khi tiếp tục."]
GOOD = ['Ví dụ nhãn: {"level_3": "dia_chi_cu", "confidence": 0.65}.', "Mã đơn in dạng <A4399> trên hộp, đừng xé bỏ.", "[Mua kèm] Phấn mắt giảm 54%.", "Mình đánh giá [tốt] ở khoản mùi, [tạm] ở khoản giá.", "Kem xài 100% ổn, %mụn giảm thấy rõ, #damat @hoilamdep.", "We saw a 404 once, yet the toner arrived on time anyway.", "Bữa đó web nghẽn, cứ báo 503 mãi.",
        "Nhiều khách báo mở app gặp lỗi 410, tổ kỹ thuật đã sửa xong từ hôm trước.", 'Bạn biên tập từng hỏi "lorem ipsum" là gì.', 'Khi trang hiện dòng "không tìm thấy trang", bạn chỉ cần gõ lại tên.', "Lúc trước máy mình tắt JavaScript nên giỏ hàng không chạy.", "Mẫu tin của tổ mình có chỗ trống cho tên khách, nhưng bản gửi đi đã điền đủ.", "Giá 825.000 ₫ là vừa túi.", ""]


@pytest.mark.parametrize("triggered", [True, False])
def test_lines(rows, triggered):
    texts = BAD + GOOD
    table = rows(list(enumerate(texts)), "i int, t string").select("i", F.transform(r.lines(F.col("t")), lambda x: r.evidence(x, triggered)).alias("k"))
    got = {x.i for x in table.collect() if any(x.k)}
    assert got == set(range(len(BAD)))


def test_documents(rows):
    texts = [(i, "Nội dung thật.\n" + t, "h", "x") for i, t in enumerate(BAD)] + [(100, None, "h", "x"), (101, "", None, "x"), (0, BAD[0], None, "x"), (102, "a" * 60_000 + " {{ x_y }}", "h", "x"), (103, "dolor magna " * 20_000, "h", "x")]
    table = rows(texts, "id long, text string, host string, kind string")
    assert {x.id for x in r.residue(table).select("id").collect()} == {*range(len(BAD)), 102, 103}
    assert r.residue(table.limit(0)).collect() == []


def test_boilerplate_is_subtracted(rows):
    foot = "This page requires a browser with scripts enabled."
    texts = [(i, f"Bài {i} hay.\n{foot}", "a") for i in range(100)] + [(200 + i, f"Bài {i}.", "b") for i in range(100)] + [(300, f"Loading\n{foot}", "b")]
    got = [(x.id, x.kind) for x in r.residue(rows(texts, "id long, text string, host string")).collect()]
    assert got == [(300, "script")]


def test_what_is_nothing_but_residue_stays(rows):
    error, menu, foot = "Lỗi 404!\nTrang không tồn tại.", "Trang chủ | Giỏ hàng", "This page requires a browser with scripts enabled."
    texts = [(i, f"{menu}\nBài {i} hay.\n{foot}", "a") for i in range(200)] + [(1000 + i, error, "a") for i in range(100)]
    # Pages that differ, of lines that recur: none has anything else to show.
    texts += [(2000 + i, "\n".join([menu] * (i + 1) + [foot]), "a") for i in range(60)]
    # The codes of two messages are not one message.
    texts += [(3000 + i, f"Bài viết {i}.\nLỗi {404 if i % 2 else 502}!", "b") for i in range(80)] + [(4000 + i, f"Tin {i}.", "b") for i in range(900)]
    got = {x.id for x in r.residue(rows(texts, "id long, text string, host string")).collect()}
    assert got == {*range(1000, 1100), *range(2000, 2060), *range(3000, 3080)}


def test_verdicts_are_alike_at_every_size(rows):
    foot, menu = "This page requires a browser with scripts enabled.", "Trang chủ"
    for times in (1, 10):
        n = 100 * times
        texts = [(i, f"Bài {i} hay.\n{foot if i < 6 * times else menu}", "six") for i in range(n)] + [(n + i, f"Bài {i} hay.\n{foot if i < 4 * times else menu}", "four") for i in range(n)]
        assert {x.id for x in r.residue(rows(texts, "id long, text string, host string")).collect()} == {*range(n, n + 4 * times)}
    # What stands in one text does not recur, however few texts the host has.
    texts = [(1, f"Bài 1.\n{foot}", "h"), (1, f"Bài 1.\n{foot}", "h"), (2, "Bài 2.", "h"), (3, f"Bài 3.\n{foot}", "g")]
    assert sorted(x.id for x in r.residue(rows(texts, "id long, text string, host string")).collect()) == [1, 1, 3]


WIDE = ["Chào {{ name | upper }},", "Mua {{ items[0].name }} nhé.", "Xem {{{ 'title' | t }}} ở đây.", "Mã {{1}} của bạn.", "{% if user == 1 %}Chào bạn", "{%- for x in items[:3] -%}", "Dear <%= user['name'] %>, hello.", "Giá ${price * 2} thôi.", "Chào ${user ? 'anh' : 'chị'} nhé.", "Gửi {0}, đơn {1} đã đi.",
        "Đơn %1$s của %2$d món.", "Chào {{ " + "x" * 60 + " }}", "Chào @@ten_" + "y" * 60 + "@@"]
NARROW = ['Nhãn {"a": {"b": 1}} và {{"c": 2}} trong sổ.', "Nhãn {{'d': 0.5}} trong sổ.", "Công thức x^{2} + a_{0} = \\frac{1}{2}.", "Mẫu \\d{2} hay [a-z]{3} và (ab){2}.", "Tập {{1, 2}, {3}} có hai phần.", "Giảm 50%, tăng 10% và 20$.", "Trên 5% < 10%, bạn hỏi ai? Mình : bạn."]


@pytest.mark.parametrize("triggered", [True, False])
def test_slots_with_more_than_a_name(rows, triggered):
    table = rows(list(enumerate(WIDE + NARROW)), "i int, t string").select("i", F.transform(r.lines(F.col("t")), lambda x: r.evidence(x, triggered)).alias("k"))
    assert {x.i for x in table.collect() if "slot" in x.k} == set(range(len(WIDE)))


def test_a_line_counts_under_each_of_its_kinds(rows):
    texts = [(1, "Chào {{ ten_khach }}, vui lòng bật JavaScript.\nBài hay.", "h"), (2, "Lỗi 404: {{ page }}", "h"), (3, "Access denied.", "h")]
    got = sorted((x.id, x.kind) for x in r.residue(rows(texts, "id long, text string, host string")).collect())
    assert got == [(1, "script"), (1, "slot"), (2, "failure"), (2, "slot"), (3, "failure")]
